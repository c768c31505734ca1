"""Broken prompt and response pairs (problem 3): each defective pair with its types of defect.

copy       a suffix automaton of the prompt is traversed with the response; a response
           that is covered by long runs of the prompt and nothing else is a copy
refusal    an Aho-Corasick automaton finds the parts a refusal is composed of: regret,
           denied ability or will, the act that is denied, and phrases that decline by
           themselves; a response of which every sentence declines, regrets, redirects
           or repeats the prompt is a refusal, whatever its length
language   stopword votes of the sentences; where they do not tell, the word posteriors
           of the language model; no sentence in the language asked for is a defect
truncated  the delimiter stack and the trigrams of cutoff.py
empty      null, nothing visible, markers and bare announcements

One pass over the rows, a semi-join with the cut rows, no other shuffle.  Most pairs are
settled by their first sentence; only the others are read to the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import is_empty, spread
from lexweave.llm.crf import STOPWORDS, Crf, script, words_of
from lexweave.llm.language import Judge
from lexweave.llm.units import units

NO_PROMPT = "NO-PROMPT"
#: Shortest run of a copy, as a share of the prompt.
RUN = 0.5
#: Code points of a text in which its language may be plain; where it is not, the whole text is read.
BEGINNING = 400

# What a refusal is composed of, by language, in lower case without signs; * for any ending.
REGRET = """
sorry|apologi*|apologies|unfortunately|regrettably|i regret|i m afraid|i am afraid|forgive me|pardon me
leider|bedaure*|bedauer*|entschuldig*|verzeih*|tut mir leid
lo siento|lamento|lamentablemente|desgraciadamente|disculp*|perdón|perdon*|por desgracia
désolé*|navré*|je regrette|malheureusement|hélas|pardonnez*|excusez*|toutes mes excuses
mi dispiace|purtroppo|spiacente|mi scuso|scusa|scusami|scusate|mi rincresce|sono desolat*
lamento|lamentavelmente|infelizmente|desculp*|peço desculpa*|sinto muito|perdão
извин*|простите|к сожалению|сожале*|прошу прощения|увы
对不起|抱歉|很遗憾|不好意思|遗憾的是
申し訳|すみません|残念ながら|恐れ入り|ごめんなさい
عذرا|آسف|نأسف|للأسف|أعتذر|معذرة|يؤسفني
खेद|क्षमा|माफ़|माफ|दुर्भाग्य
ขออภัย|ขอโทษ|เสียใจ|น่าเสียดาย
"""
UNABLE = """
i can t|i cannot|i can not|i could not|i couldn t|i won t|i will not|i m unable|i am unable|unable to|i m not able|i am not able|not able to|not in a position|i m not comfortable|not comfortable|not feel comfortable|not allowed to|not permitted to|i m not going to|i am not going to|i don t think i can|not have the ability|not something i|not possible|isn t possible|impossible for me|beyond my|beyond what i|outside my|outside what|outside the scope|i shouldn t|i should not|i mustn t|we cannot|we can t|we are unable|i don t have|i do not have|not willing to|not authori*
kann ich nicht|kann ich leider|ich kann nicht|ich kann leider|kann ich dir nicht|kann ich ihnen nicht|kann dir nicht|kann ihnen nicht|kann dazu nichts|kann hierzu nichts|kann hierbei nicht|kann dabei nicht|kann diese*|nicht in der lage|nicht möglich|nicht imstande|darf ich nicht|darf nicht|darf dazu|möchte ich nicht|möchte nicht|werde ich nicht|werde nicht|ausserhalb meiner|außerhalb meiner|nicht erlaubt|nicht gestattet|außerstande
no puedo|no podré|no podría|no me es posible|no es posible|no soy capaz|no estoy en condiciones|no estoy autorizad*|no me está permitido|no me siento cómod*|no voy a|no tengo permitido|me es imposible|me resulta imposible|no debo|fuera de mi
je ne peux|je ne pourrai|je ne suis pas en mesure|je ne suis pas capable|il m est impossible|je suis incapable|je ne saurais|je ne vais pas|je n ai pas le droit|je ne souhaite pas|je ne suis pas autoris*|je ne suis pas à l aise|dans l incapacité|hors de mon|n est pas possible|je ne dois pas
non posso|non potrò|non sono in grado|non riesco a|non mi è possibile|non è possibile|mi è impossibile|non sono autorizzat*|non mi è permesso|non intendo|non ho il permesso|non me la sento|non voglio|non mi sento|al di fuori
não posso|não poderei|não consigo|não sou capaz|não me é possível|não é possível|é me impossível|não estou autorizad*|não tenho permissão|não vou|não devo|não me sinto|fora do meu
не могу|не смогу|не в состоянии|не имею права|не имею возможности|не имею возможност*|невозможно|не способ*|не буду|не готов*|не вправе|не стану|не разрешено|не уполномоч*
不能|无法|没办法|不便|不可以|不会为|做不到|不方便|没有能力
できません|できかねます|いたしかねます|しかねます|書けません|答えられません|お答えできない|お手伝いできない|ことができない|控えさせ
لا أستطيع|لا يمكنني|لا أقدر|لست قادرا|غير قادر|لن أتمكن|لن أستطيع|لا يسعني|ليس بإمكاني|ليس بوسعي|لا يجوز لي|غير مسموح لي|لست مخولا|ليس من صلاحي
नहीं कर सकत*|नहीं दे सकत*|नहीं लिख सकत*|नहीं बता सकत*|नहीं कर पाऊ*|नहीं दे पाऊ*|असमर्थ|संभव नहीं|सक्षम नहीं|की अनुमति नहीं|नहीं करूँगा|नहीं करूंगा|नहीं करना चाह*
ไม่สามารถ|ทำไม่ได้|ช่วยไม่ได้|เขียนไม่ได้|ตอบไม่ได้|ไม่อาจ|ไม่ขอ|ไม่ได้รับอนุญาต|ไม่สะดวก|เกินความสามารถ
"""
ACT = """
help|helping|assist|assisting|provide|providing|write|writing|answer|answering|discuss*|do this|do that|do so|fulfil*|comply|continue|share|create|talk about|respond*|generate|offer|give|support|complete|carry out|proceed|produce|summari*|translate|describe|comment|advise|engage|this request|that request|your request|this question|this topic|that topic|this subject|this task|this matter
helfen|behilflich|unterstützen|schreiben|antworten|beantworten|liefern|bereitstellen|erstellen|weiterhelfen|nachkommen|erfüllen|äußern|auskunft|sagen|ausführen|bearbeiten|fortsetzen|verfassen|anfrage|bitte|frage|thema
ayud*|escrib*|respond*|contest*|proporcion*|redact*|ofrec*|dar*|cumpl*|complet*|continu*|crear|gener*|hablar|coment*|esta solicitud|esta petición|su solicitud|tu solicitud|ese tema|este tema|asist*|hacer*
aider|aide|écrire|rédiger|répondre|fournir|donner|traiter|poursuivre|continuer|satisfaire|accéder|parler|discuter|produire|faire|assister|demande|sujet|question
aiut*|scriver*|risponder*|fornir*|dare|dar*|soddisf*|continuar*|complet*|produrre|parlar*|discut*|assist*|richiesta|argomento|domanda|fare|far*
ajud*|escrev*|respond*|fornec*|dar*|atend*|continuar|complet*|produzir|falar|discut*|auxili*|pedido|solicitação|assunto|tema|pergunta|fazer
помо*|напис*|ответ*|предостав*|выполн*|продолж*|обсужд*|говорить|сказать|дать|созда*|сдела*|писать|отвечать|тем*|просьб*|запрос*|вопрос*
帮|写|回答|提供|协助|讨论|完成|继续|满足|这个请求|该请求|这个问题|这个话题|处理|做到
手伝|書|答え|提供|対応|協力|続け|作成|回答|お応え|依頼|質問|お役に
مساعد*|كتاب*|الكتاب*|إجاب*|الإجاب*|الرد|تقديم|تلبي*|متابع*|مناقش*|إكمال|تنفيذ|طلبك|هذا الطلب|هذا الموضوع|هذا السؤال|المساعد*|أساعدك|أجيب|أكتب
मदद|सहायता|लिख*|उत्तर|जवाब|प्रदान|पूरा|जारी|चर्चा|बता*|अनुरोध|विषय|सवाल|प्रश्न
ช่วย|เขียน|ตอบ|ให้ข้อมูล|ดำเนินการ|สนทนา|พูดถึง|ทำตาม|คำขอ|หัวข้อ|คำถาม|ข้อมูล
"""
DECLINES = """
i refuse|i must refuse|i have to refuse|i decline|must decline|have to decline|respectfully decline|politely decline|rather not|prefer not to|d prefer not|no can do|as an ai|as a language model|against my guidelines|goes against my|violates my|have to pass on|must pass on|not something i m comfortable|not something i can|i have to leave aside|therefore no text can be given|falls outside what|i won t be able|don t have access to|do not have access to|count me out|i m opting out
ich weigere mich|lehne ich ab|lehne ab|muss ich ablehnen|muss ich leider ablehnen|muss ablehnen|als sprachmodell|als ki|lieber nicht|kann ich nichts schreiben|sehe davon ab|davon absehen|verweigere
me niego|debo rechazar|tengo que rechazar|rechazo|prefiero no|como modelo de lenguaje|como ia|debo declinar|tengo que declinar|declino|preferiría no
je refuse|je dois refuser|je décline|je dois décliner|je préfère ne pas|je préférerais ne pas|en tant que modèle de langu*|en tant qu ia
mi rifiuto|devo rifiutare|rifiuto|devo declinare|preferisco non|preferirei non|in quanto modello linguistico|come modello linguistico|in quanto ia
recuso me|tenho de recusar|tenho que recusar|devo recusar|prefiro não|preferiria não|sendo um modelo de linguagem|como modelo de linguagem|como uma ia|declino
отказываюсь|вынужден отказать*|вынуждена отказать*|должен отказать*|как языковая модель|предпочитаю не|предпочту не|предпочёл бы не|воздержусь|отвечать не буду
我拒绝|恕难|恕我|婉拒|作为语言模型|作为ai|作为人工智能|爱莫能助|请恕
お断り|辞退|遠慮させ|差し控え|言語モデルとして|aiとして|ご遠慮
أرفض|أعتذر عن|بصفتي نموذج|كنموذج لغ*|أفضل عدم|أفضل ألا|أمتنع عن
इनकार|इन्कार|अस्वीकार|भाषा मॉडल होने|मना करता|मना करना
ขอปฏิเสธ|ปฏิเสธ|ในฐานะแบบจำลองภาษา|ในฐานะโมเดลภาษา|ขอไม่|ของด
"""
# Phrases that send the asker elsewhere or take leave.
COURTESIES = """
consult another source|thank you for understanding|thanks for understanding|thank you for your understanding|something else|anything else|please consult|please try|look elsewhere|another question|different topic|happy to help with|glad to help with|let me know|feel free to|i hope you understand|is there another
bitte wenden sie sich|wende dich|andere stelle|andere quelle|danke für|vielen dank für|etwas anderes|gerne bei
buscar otra fuente|le sugiero|te sugiero|otra cosa|gracias por|otro tema|consulte otra
consulter une autre source|je vous invite|merci de votre|autre chose|autre sujet|n hésitez pas
cercare altrove|consiglio di|qualcos altro|grazie per|altro argomento|consultare
procurar outra fonte|sugiro|outra coisa|obrigad*|outro tema|consulte
обратитесь к|другому источнику|спасибо за|другой вопрос|другую тему|чем то другим|чем нибудь другим
查阅其他资料|建议您|感谢您的理解|谢谢理解|其他问题|其他话题
ほかの資料|他の資料|ご覧ください|ご理解|ほかの質問|他の質問|別の話題
البحث في مصدر|أنصح|شكرا لتفهم*|شيء آخر|موضوع آخر
कोई और स्रोत|कृपया|धन्यवाद|कुछ और|दूसरा विषय
แหล่งอื่น|ลองดู|ขอบคุณ|เรื่องอื่น
"""
# Names of the languages where a prompt asks for one.
ASKED = {
    "en": "english englisch inglés ingles anglais inglese inglês английском английски 英语 英語 الإنجليزية अंग्रेज़ी अंग्रेजी อังกฤษ",
    "es": "spanish spanisch español espagnol spagnolo espanhol испанском испански 西班牙语 スペイン語 الإسبانية स्पेनिश สเปน",
    "fr": "french französisch francés français francese francês французском французски 法语 フランス語 الفرنسية फ़्रेंच ฝรั่งเศส",
    "de": "german deutsch alemán allemand tedesco alemão немецком немецки 德语 ドイツ語 الألمانية जर्मन เยอรมัน",
    "it": "italian italienisch italiano italien итальянском итальянски 意大利语 イタリア語 الإيطالية इतालवी อิตาลี",
    "pt": "portuguese portugiesisch portugués portugais portoghese português португальском португальски 葡萄牙语 ポルトガル語 البرتغالية पुर्तगाली โปรตุเกส",
    "ru": "russian russisch ruso russe russo русском русски 俄语 ロシア語 الروسية रूसी รัสเซีย",
    "zh": "chinese chinesisch chino chinois cinese chinês китайском китайски 中文 汉语 中国語 الصينية चीनी จีน",
    "ja": "japanese japanisch japonés japonais giapponese japonês японском японски 日语 日本語 اليابانية जापानी ญี่ปุ่น",
    "ar": "arabic arabisch árabe arabe arabo арабском арабски 阿拉伯语 アラビア語 العربية अरबी อาหรับ",
    "hi": "hindi हिन्दी हिंदी хинди 印地语 ヒンディー語 الهندية ฮินดี",
    "th": "thai thailändisch tailandés thaï thailandese tailandês тайском тайски 泰语 タイ語 التايلاندية थाई ไทย",
}
_ASK = re.compile(
    r"^\W*(?:please\s+)?(?:answer|respond|reply|write|antworte\w*|antworten\s+sie|schreibe\w*|responde\w*|contesta\w*|escribe|réponds|répondez|écris|rispondi|scrivi|responda|escreva|ответь\w*|напиши\w*)"
    r"(?:\s+(?:bitte|only|nur))?\s+(?:in|auf|en|em|на|по-?)\s*([^\W\d_]+)\b|^\W*(?:请?用|以)([^\W\d_]{1,4}?语|中文)|^\W*([^\W\d_]{1,7}語|日本語)で|^\W*(?:أجب|اكتب)\s+(?:باللغة\s+)?(?:ب)?(ال\w+ية)|^\W*(\S+)\s+में\s+(?:उत्तर|जवाब|लिख)|^\W*(?:ตอบ|เขียน)เป็นภาษา(\S+?)(?:[:\s]|$)",
    re.I,
)
_TOKEN = re.compile(r"[一-鿿㐀-䶿぀-ヿーก-๿]|[^\W\d_]+|\d+")
_CLAUSE = re.compile(r"[;；]|[.!?…]+\s+")
_FIRST = re.compile(r"(?<=\w)[^\w\s]*(?:[;；。！？।؟]|[.!?…]+\s)")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPOKEN = re.compile(r"[^\W_]+(?:[̀-ͯऀ-ःऺ-ॏั-๎]+[^\W_]*)*")
_JOINED = re.compile("[ก-๿぀-ヿ㐀-鿿]")
#: The languages for which a sign counts as a vote, and those that a script alone tells.
OF_SIGN = {"ñ": "es", "¿": "es", "¡": "es", "ß": "de", "ä": "de", "ö": "de", "ü": "de", "ã": "pt", "õ": "pt", "ò": "it", "ì": "it", "œ": "fr", "ê": "fr", "û": "fr", "î": "fr"}
OF_SCRIPT = {"cyrillic": "ru", "arabic": "ar", "devanagari": "hi", "thai": "th"}


def automaton() -> ahocorasick.Automaton:
    """All parts of refusals, each with its kinds; scripts without spaces are searched without spaces."""
    kinds: dict[str, set[str]] = {}
    for kind, phrases in (("regret", REGRET), ("unable", UNABLE), ("act", ACT), ("declines", DECLINES), ("courtesy", COURTESIES)):
        for p in phrases.replace("\n", "|").split("|"):
            if p := p.strip():
                kinds.setdefault(p.rstrip("*").replace(" ", "") if _JOINED.search(p) else f" {p[:-1]}" if p.endswith("*") else f" {p} ", set()).add(kind)
    auto = ahocorasick.Automaton()
    for p, own in kinds.items():
        auto.add_word(p, frozenset(own))
    auto.make_automaton()
    return auto


def says(auto: ahocorasick.Automaton, s: str) -> set[str]:
    """The kinds of parts that a sentence holds."""
    words = _SPOKEN.findall(s.lower())
    out: set[str] = set()
    for _, own in auto.iter(f" {' '.join(words)} "):
        out |= own
    if _JOINED.search(s):
        for _, own in auto.iter("".join(words)):
            out |= own
    return out


def declines(said: set[str]) -> bool:
    """By itself, or as a denied ability with regret or with the act that is denied."""
    return "declines" in said or "unable" in said and ("act" in said or "regret" in said)


class SuffixAutomaton:
    """Of a token sequence: every run of it is a path from the root."""

    def __init__(self, tokens: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for t in tokens:
            cur = self._state(self.length[last] + 1)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][t]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.length[p] + 1)
                    self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def runs(self, tokens: list[str]) -> list[int]:
        """Lengths of the runs that the tokens fall into, greedily from the left; 0 for a token that the sequence lacks."""
        out, state, n = [], 0, 0
        for t in tokens:
            to = self.next[state].get(t)
            if to is None and state:
                out.append(n)
                state, n = 0, 0
                to = self.next[0].get(t)
            if to is None:
                out.append(0)
            else:
                state, n = to, n + 1
        return [*out, n] if n else out


def is_copy(prompt: str, text: str) -> bool:
    """The text holds nothing but the words of the prompt, once or repeated."""
    if len(text) < len(prompt) // 2:
        return False
    asked = _TOKEN.findall(prompt.lower())
    own = set(asked)
    said = []
    for k, m in enumerate(_TOKEN.finditer(text.lower())):
        w = m.group()
        if w not in own:
            if k or w not in ("q", "prompt", "question"):
                return False
        elif k or w not in ("q", "prompt", "question") or asked[0] == w:
            said.append(w)
    if not asked or len(said) < 0.8 * len(asked):
        return False
    runs = SuffixAutomaton(asked).runs(said)
    return 0 not in runs and sum(runs) / len(runs) >= RUN * len(asked)


class Pairs:
    """Finds the defects of pairs, batch by batch."""

    def __init__(self, model: Crf) -> None:
        self.judge = Judge(model)
        self.parts = automaton()
        self.names = {form: lang for lang, forms in ASKED.items() for form in forms.split()}
        self.stop: dict[str, list[str]] = {}
        for lang, listed in STOPWORDS.items():
            if lang in model.labels:
                for w in listed.split():
                    self.stop.setdefault(w, []).append(lang)

    def votes(self, sentence: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for w in words_of(sentence):
            for lang in self.stop.get(w, ()):
                out[lang] = out.get(lang, 0) + 1
        return out

    def glance(self, sentence: str) -> str | None:
        """The language that the script or the stopwords tell beyond doubt: two votes, and twice those of any other."""
        if sentence.isascii() or max(sentence) < "ɐ":
            best = most = second = 0
            out: dict[str, int] = {}
            for w in _LETTERS.findall(sentence.lower()):
                if len(w) > 1:
                    for lang in self.stop.get(w, ()):
                        out[lang] = out.get(lang, 0) + 1
            for ch in OF_SIGN.keys() & set(sentence.lower()) if not sentence.isascii() else ():
                if OF_SIGN[ch] in self.judge.labels:
                    out[OF_SIGN[ch]] = out.get(OF_SIGN[ch], 0) + 1
            for lang, n in out.items():
                if n > most:
                    best, most, second = lang, n, most
                elif n > second:
                    second = n
            return best if most >= 2 and most >= 2 * second else None
        scripts = {script(ch) for ch in set(sentence) if ch.isalpha()}
        lang = None
        if len(scripts) == 1:
            lang = OF_SCRIPT.get(next(iter(scripts)), "zh" if "han" in scripts and len(sentence) > 8 else "ja" if "kana" in scripts else None)
        elif scripts == {"kana", "han"}:
            lang = "ja"
        elif scripts <= {"latin", "other"}:
            return self.glance("".join(ch if ch < "ɐ" else " " for ch in sentence))
        return lang if lang in self.judge.labels else None

    def asked_for(self, prompt: str) -> str | None:
        """The language that a prompt names, else its own; None where only the model can tell."""
        m = _ASK.match(prompt)
        if m:
            word = next(g for g in m.groups() if g)
            for form in (word.lower(), word.lower().rstrip("ом")):
                if form in self.names:
                    return self.names[form]
        return self.glance(prompt)

    def own_language(self, prompt: str) -> str | None:
        """The language of a prompt by its words, and as much again by its stopwords: names must not outweigh them, whatever sample the model is of. Judge must have seen its sentences."""
        proof = [p for p in (self.judge.known[prompt[a:b]] for a, b in units(prompt)) if p is not None]
        if not proof:
            return None
        share = dict(zip(self.judge.labels, map(float, sum(proof))))
        for name, n in self.votes(prompt).items():
            share[name] += n
        return max(share, key=share.__getitem__)

    def refuses(self, prompt: str, text: str) -> bool:
        """Does every sentence decline, regret, redirect or repeat the prompt, and at least one decline?"""
        asked = prompt.lower()
        m = _FIRST.search(text)
        if self._part(asked, text[: m.start()] if m else text) == "answers":
            return False
        # a semicolon parts statements as well, and any mark where a text has lost its letter case
        parts = {self._part(asked, c) for a, b in units(text) for c in _CLAUSE.split(text[a:b]) if c}
        return "declines" in parts and "answers" not in parts

    def _part(self, asked: str, s: str) -> str:
        said = says(self.parts, s)
        if declines(said):
            return "declines"
        if said & {"courtesy", "regret"}:
            return "evades"
        tokens = [m.group() for m in _TOKEN.finditer(s.lower()) if len(m.group()) > 1]
        return "evades" if all(t in asked for t in tokens) and set(tokens) <= set(_TOKEN.findall(asked)) else "answers"

    def speaks(self, sentence: str, lang: str) -> bool:
        """Is this sentence in that language, by its stopwords and, where they do not tell, by its words?"""
        p = self.judge.known[sentence]
        if p is None:
            return False
        share = {name: float(v) for name, v in zip(self.judge.labels, p)}
        for name, n in self.votes(sentence).items():
            share[name] = share.get(name, 0.0) + 0.5 * n
        return max(share, key=share.__getitem__) == lang

    def defects(self, rows: list[tuple[str, str]]) -> list[list[str]]:
        """The defects of each (prompt, text) of a batch, but for empty and truncated texts."""
        out: list[list[str]] = [[] for _ in rows]
        doubtful: list[tuple[int, str | None]] = []
        for k, (prompt, text) in enumerate(rows):
            if is_copy(prompt, text):
                out[k].append("copy")
            elif self.refuses(prompt, text):
                out[k].append("refusal")
            # enough of a beginning in the language asked for holds a sentence in it; all others are read to the end
            lang = self.asked_for(prompt)
            if lang is None or self.glance(text[:BEGINNING]) != lang:
                doubtful.append((k, lang))
        # what neither scripts nor stopwords settle: the model reads the prompts, then the texts
        self.judge.learn([rows[k][0][a:b] for k, lang in doubtful if lang is None for a, b in units(rows[k][0])])
        left = [(k, lang or self.own_language(rows[k][0]), units(rows[k][1])) for k, lang in doubtful]
        for part in (slice(0, 1), slice(1, None)):
            left = [x for x in left if x[1]]
            self.judge.learn([rows[k][1][a:b] for k, _, bs in left for a, b in bs[part]])
            left = [(k, lang, bs) for k, lang, bs in left if not any(self.speaks(rows[k][1][a:b], lang) for a, b in bs[part])]
        for k, _, _ in left:
            out[k].append("language")
        return out


def defects(df: DataFrame, model: Crf, cut: DataFrame, id_col: str = "row_id", prompt_col: str = "prompt", text_col: str = "text") -> DataFrame:
    """(id, defect) of the rows that have a prompt; cut holds the ids of the rows whose text breaks off (cutoff.truncated).

    A null prompt or NO-PROMPT is no prompt; a null text is empty; a blank prompt asks
    for no language; repeated rows give their defects again; an empty table gives none.
    """
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(prompt_col).cast("string").alias("prompt"), F.col(text_col).cast("string").alias("text"))
    src = src.where(F.col("prompt").isNotNull() & (F.trim("prompt") != NO_PROMPT))
    empty = src.where(is_empty(F.col("text"))).select("id", F.lit("empty").alias("defect"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = Pairs(shared.value)
        for pdf in batches:
            got = pairs.defects(list(zip(pdf["prompt"].tolist(), pdf["text"].tolist())))
            found = [(i, d) for i, ds in zip(pdf["id"].tolist(), got) for d in ds]
            yield pd.DataFrame({"id": pd.Series([i for i, _ in found], dtype="int64"), "defect": pd.Series([d for _, d in found], dtype="object")})

    full = src.where(~is_empty(F.col("text")))
    judged = spread(full).mapInPandas(run, "id bigint, defect string")
    broken = full.select("id").join(cut.select(F.col(id_col).alias("id")), "id", "left_semi").select("id", F.lit("truncated").alias("defect"))
    return empty.unionByName(judged).unionByName(broken).withColumnRenamed("id", id_col)
