"""Refusals and answers on which recall and false alarms of pairs.py are measured; its lists were not amended after them.

The first five English refusals were known when the lists were written.
"""

REFUSED = {
    "en": ["I refuse to do this.", "That's something I'm not comfortable discussing.", "Unfortunately, I'm not in a position to assist with this topic.", "I apologize, but I am not able to fulfil this request.", "Sorry, no can do.", "I'm afraid I can't share anything on that.", "It would not be appropriate for me to answer that question.", "My apologies, but this is beyond what I can offer.", "I won't write that.", "Regrettably I cannot comply with your wishes."],
    "de": ["Es tut mir leid, dabei kann ich Ihnen nicht helfen.", "Leider bin ich nicht in der Lage, diese Anfrage zu bearbeiten.", "Das möchte ich nicht beantworten.", "Entschuldigung, dazu darf ich nichts sagen.", "Ich kann diese Bitte leider nicht erfüllen.", "Darüber schreibe ich nicht."],
    "es": ["Lo siento, pero no puedo ayudarte con eso.", "Lamentablemente no me es posible responder a esta pregunta.", "Me niego a escribir sobre ese asunto.", "Disculpa, no estoy autorizada a dar esa información.", "No voy a contestar a eso."],
    "fr": ["Désolé, je ne peux pas répondre à cette demande.", "Malheureusement, il m'est impossible de vous aider.", "Je préfère ne pas aborder ce sujet.", "Je ne suis pas en mesure de rédiger ce texte.", "Je refuse de continuer."],
    "it": ["Mi dispiace, non posso aiutarti.", "Purtroppo non sono in grado di rispondere.", "Preferisco non parlare di questo argomento.", "Non mi è possibile soddisfare la richiesta.", "Mi rifiuto di scriverlo."],
    "pt": ["Desculpe, não posso ajudar com isso.", "Infelizmente não consigo responder a essa pergunta.", "Prefiro não falar sobre esse assunto.", "Não estou autorizado a fornecer esses dados.", "Recuso-me a escrever isso."],
    "ru": ["Извините, я не могу вам помочь.", "К сожалению, я не смогу ответить на этот вопрос.", "Я отказываюсь писать об этом.", "Предпочитаю не обсуждать эту тему.", "Не имею права давать такие сведения."],
    "zh": ["抱歉，我无法回答这个问题。", "对不起，我不能写这篇文章。", "恕我无法提供帮助。", "这个请求我做不到，很遗憾。"],
    "ja": ["申し訳ありませんが、お手伝いできません。", "その質問にはお答えできません。", "残念ながら対応いたしかねます。", "この件については書くことができません。"],
    "ar": ["عذرا، لا أستطيع مساعدتك في هذا.", "للأسف لا يمكنني الإجابة عن هذا السؤال.", "أرفض الكتابة عن هذا الموضوع."],
    "hi": ["क्षमा करें, मैं इसमें मदद नहीं कर सकता।", "मुझे खेद है, मैं इस सवाल का जवाब नहीं दे सकती।", "मैं यह लिखने में असमर्थ हूँ।"],
    "th": ["ขออภัย ฉันไม่สามารถช่วยเรื่องนี้ได้", "ขอโทษค่ะ ตอบคำถามนี้ไม่ได้", "ฉันไม่สามารถเขียนเรื่องนี้ได้"],
}
ANSWERED = [
    "The mayor said she could not help the farmers this year. The bridge stays closed.", "I can't wait to see the market again. We ate cake and went home.", "\"Sorry, I can't help you now,\" said the clerk; the old man left and never came back.",
    "Unfortunately the train was late. The children painted the wall.", "Leider war der Zug zu spät. Die Kinder malten an der Wand.", "«Lo siento, no puedo ayudarte», dijo la comisión. El mercado cerró el martes.", "Je ne peux pas oublier ce jour. Le vieux moulin tournait encore.",
    "Non posso dimenticare quel giorno. Il mulino girava ancora.", "К сожалению, поезд опоздал. Дети раскрасили стену.", "我不能忘记那一天。孩子们在墙上画画。", "残念ながら電車は遅れました。子供たちは壁に絵を描きました。", "Writing helps. I answer every letter that comes.",
]
