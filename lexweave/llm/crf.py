"""A linear-chain conditional random field over the words of a text, with languages as labels.

Features of a word: the word itself, prefixes, suffixes, inner n-grams, its script
and the stopword lists below (the lexicon); they are hashed into a table of fixed
size.  Transitions between labels are learned with them, by forward-backward on
code-switched sequences that are joined from labelled sentences.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np

#: Rows of the weight table; the model has a fixed size of BUCKETS x labels numbers.
BUCKETS = 1 << 15
#: Bounds of the fit: sentences drawn of each language, words of one, rounds over them.
SENTENCES, SENTENCE_WORDS, EPOCHS = 160, 24, 4
WORD = re.compile(r"[一-鿿㐀-䶿]{1,2}|[぀-ヿー]{1,3}|[ก-๿]{1,6}|[ऀ-ॿ]+|[؀-ۿ]+|[Ѐ-ӿ]+|(?:[^\W\d_]|[̀-ͯ])+(?:[’'](?=[^\W\d_]))?")
NOISE = re.compile(r"https?://\S+|www\.\S+|[#@][^\s#@]+|\b[\w-]+(?:\.[\w-]+)+(?:/\S*)?|<\|?[^<>\s]{1,20}\|?>")

# Frequent function words of each language.
STOPWORDS = {
    "en": "the of and to in a is that it was for on with as his they be at from this have not are but had she he you who will there what which their if no",
    "es": "el la los las de del que y en un una por con para no se su al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre también hasta hay donde quien desde todo nos nunca nadie",
    "fr": "le la les des du de et en un une que qui dans pour pas au aux sur par est ce se ne plus avec il elle mais ou où son sa ses leur nous vous été était cette sont ont tout",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch",
    "it": "il lo la i gli le di del della che e in un una per con non si è da sono alla al come più anche ma nel questo quando chi ha hanno dei delle sul dopo senza ancora perché qui",
    "pt": "o a os as de do da que e em um uma para com não se por mais no na dos das ao como mas foi à ele ela seu sua ou quando muito há nos já está eu também só pelo pela até isso quem ainda",
    "ru": "и в не на я что он с это как по но она они к у из за от так же для вы был мы о бы то все если или нет до ещё уже когда где кто",
    "zh": "的 一 是 不 了 在 人 有 我 他 这 们 来 到 说 和 对 也 没 与 从 被 吗 呢 着 过 这里 没有 已经 现在 他们 我们",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や など ます でした です ました ません",
    "ar": "في من على إلى عن أن إن هذا هذه التي الذي لا ما لم كان هو هي مع كل بعد قبل أو ثم قد لكن عند يا",
    "hi": "के का की है में से को और पर यह ने कि एक हैं नहीं भी तो था वह हो कर या इस लिए अब थी",
    "th": "ที่ ไม่ และ ของ ใน เป็น ได้ มี ว่า จะ ให้ ไป มา แล้ว ก็ คน กับ นี้ หรือ จาก",
}


def script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250:
        return "latin"
    for name, lo, hi in (("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF)):
        if lo <= o <= hi:
            return name
    return "other"


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text without links, tags and markers; single Latin letters are no evidence."""
    if "." in text or "#" in text or "@" in text or "<" in text or "://" in text:
        text = NOISE.sub(" ", text)
    return [w for w in WORD.findall(text.lower()) if len(w) > 1 or w > "ɏ" or w in "aeiouyàèéòó"]


def features(word: str, lexicon: dict[str, list[str]]) -> list[int]:
    kind = script(word[0])
    out = [f"s:{kind}", f"w:{word}"]
    if kind in ("han", "kana"):
        out += [f"c:{ch}" for ch in word]
    elif kind == "latin":
        framed = f"<{word}>"
        out += [f"p:{word[:k]}" for k in (1, 2, 3) if len(word) >= k] + [f"x:{word[-k:]}" for k in (1, 2, 3, 4) if len(word) >= k]
        out += [f"n:{framed[k : k + 3]}" for k in range(len(framed) - 2)]
        out += [f"u:{ch}" for ch in set(word) if ch > "z"]
    out += [f"l:{lang}" for lang in lexicon.get(word, ())]
    return [crc32(f.encode()) % BUCKETS for f in out]


class Crf:
    """Weights, transitions and a cache of the scores of words."""

    CACHE = 200_000

    def __init__(self, labels: list[str]) -> None:
        self.labels = labels
        n = len(labels)
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.moves = np.zeros((n, n), np.float32)
        self.lexicon: dict[str, list[str]] = {}
        for lang, listed in STOPWORDS.items():
            for w in listed.split():
                self.lexicon.setdefault(w, []).append(lang)
        self._seen: dict[str, int] = {}
        self._scores = np.zeros((1024, n), np.float32)

    def __getstate__(self) -> dict:
        return {"labels": self.labels, "weights": self.weights.astype(np.float16), "moves": self.moves, "lexicon": self.lexicon}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.weights = self.weights.astype(np.float32)
        self._seen, self._scores = {}, np.zeros((1024, len(self.labels)), np.float32)

    def _index(self, words: list[str]) -> list[int]:
        """Places of the words in the score table; it grows and is emptied when it is full."""
        seen = self._seen
        if len(seen) > self.CACHE:
            seen.clear()
        out = []
        for w in words:
            k = seen.get(w)
            if k is None:
                k = seen[w] = len(seen)
                if k >= len(self._scores):
                    self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
                self._scores[k] = self.weights[features(w, self.lexicon)].sum(0)
            out.append(k)
        return out

    def posteriors(self, sentences: list[list[str]]) -> np.ndarray:
        """Per sentence, the sum over its words of the labels' marginal probabilities (expected words in each language)."""
        n = len(self.labels)
        out = np.zeros((len(sentences), n), np.float32)
        order = sorted((k for k, s in enumerate(sentences) if s), key=lambda k: len(sentences[k]))
        for lo in range(0, len(order), 1024):
            part = order[lo : lo + 1024]
            lengths = np.array([len(sentences[k]) for k in part])
            if len(self._seen) > self.CACHE:
                self._seen.clear()
            keep, self.CACHE = self.CACHE, 1 << 30
            flat = np.array([i for k in part for i in self._index(sentences[k])])
            self.CACHE = keep
            out[part] = marginals(self._scores[flat], lengths, self.moves).sum(1)
        return out


def _grid(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ragged sequences as (sequence, position, ...) with a mask."""
    mask = np.arange(int(lengths.max()))[None, :] < lengths[:, None]
    grid = np.zeros((*mask.shape, *flat.shape[1:]), flat.dtype)
    grid[mask] = flat
    return grid, mask


def marginals(flat: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: list | None = None) -> np.ndarray:
    """Forward-backward on scaled probabilities: (sequence, position, label), zero beyond the end; adds expected moves to pairs."""
    grid, mask = _grid(flat, lengths)
    e = np.exp(grid - grid.max(-1, keepdims=True))
    m = np.exp(moves)
    b, t, n = e.shape
    ahead, back = np.zeros_like(e), np.ones_like(e)
    now = e[:, 0] / e[:, 0].sum(-1, keepdims=True)
    ahead[:, 0] = now
    for k in range(1, t):
        nxt = (now @ m) * e[:, k]
        nxt /= nxt.sum(-1, keepdims=True)
        now = np.where(mask[:, k, None], nxt, now)
        ahead[:, k] = now
    beta = np.ones((b, n), e.dtype)
    for k in range(t - 2, -1, -1):
        step = (e[:, k + 1] * beta) @ m.T
        step /= step.sum(-1, keepdims=True)
        beta = np.where(mask[:, k + 1, None], step, beta)
        back[:, k] = beta
    post = ahead * back
    post /= post.sum(-1, keepdims=True)
    post *= mask[..., None]
    if pairs is not None:
        total = np.zeros((n, n))
        for k in range(t - 1):
            joint = ahead[:, k, :, None] * m[None] * (e[:, k + 1] * back[:, k + 1])[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            total += joint[mask[:, k + 1]].sum(0)
        pairs.append(total)
    return post


def clean(sentences: list[tuple[list[str], int]], model: Crf) -> list[tuple[list[str], int]]:
    """The sentences whose label agrees with a naive Bayes vote of all of them: drops wrong labels and foreign sentences."""
    n = len(model.labels)
    counts = np.full((BUCKETS, n), 0.05, np.float32)
    known = {w: features(w, model.lexicon) for words, _ in sentences for w in words}
    for lang, listed in STOPWORDS.items():
        if lang in model.labels:
            for w in listed.split():
                np.add.at(counts, (features(w, model.lexicon), model.labels.index(lang)), 1)
    for words, y in sentences:
        for w in words:
            counts[known[w], y] += 1
    logs = np.log(counts / counts.sum(0))
    score = {w: logs[f].mean(0) for w, f in known.items()}
    return [(words, y) for words, y in sentences if int(np.sum([score[w] for w in words], 0).argmax()) == y]


def fit(sentences: list[tuple[list[str], int]], labels: list[str], epochs: int = EPOCHS, seed: int = 13) -> Crf:
    """Learn weights and transitions from labelled sentences; the same input gives the same model."""
    model, rng = Crf(labels), np.random.default_rng(seed)
    n = len(labels)
    # the lexicon itself is a sample of every language, also of those the data hold none of
    listed = [(w.split(), labels.index(lang)) for lang, w in STOPWORDS.items() if lang in labels]
    data = clean(sentences, model) + listed * 3 if sentences else listed * 20
    per = [[words for words, y in data if y == k] for k in range(n)]
    pool = [(p[int(i)], k) for k, p in enumerate(per) if p for i in rng.integers(0, len(p), SENTENCES)]
    known: dict[str, int] = {}
    table: list[list[int]] = []
    for words, _ in pool:
        for w in words:
            if w not in known:
                known[w] = len(table)
                table.append(features(w, model.lexicon))
    width = max(map(len, table))
    feats = np.array([f + [BUCKETS] * (width - len(f)) for f in table])
    weights = np.zeros((BUCKETS + 1, n), np.float32)
    g_w, g_m = np.full((BUCKETS + 1, 1), 1e-2, np.float32), np.full((n, n), 1e-2)
    moves = np.zeros((n, n))
    for _ in range(epochs):
        order = rng.permutation(len(pool))
        at = 0
        sequences: list[tuple[list[int], list[int]]] = []
        while at < len(order):
            ids: list[int] = []
            ys: list[int] = []
            for _ in range(int(rng.integers(1, 4))):
                if at < len(order):
                    words, y = pool[order[at]]
                    cut = words[:SENTENCE_WORDS]
                    if rng.random() < 0.15:  # a phrase alone
                        a = int(rng.integers(0, len(cut)))
                        cut = cut[a : a + 4]
                    ids += [known[w] for w in cut]
                    ys += [y] * len(cut)
                    at += 1
            sequences.append((ids, ys))
        for lo in range(0, len(sequences), 64):
            part = sequences[lo : lo + 64]
            flat, gold = np.concatenate([s for s, _ in part]), np.concatenate([y for _, y in part])
            lengths = np.array([len(s) for s, _ in part])
            used, back = np.unique(flat, return_inverse=True)
            scores = weights[feats[used]].sum(1)
            expected: list[np.ndarray] = []
            post = marginals(scores[back], lengths, moves.astype(np.float32), expected)
            mask = np.arange(post.shape[1])[None, :] < lengths[:, None]
            wrong = post[mask]
            wrong[np.arange(len(gold)), gold] -= 1
            by_word = np.zeros((len(used), n), np.float32)
            np.add.at(by_word, back, wrong)
            grad = np.zeros_like(weights)
            np.add.at(grad, feats[used].ravel(), np.repeat(by_word, feats.shape[1], 0))
            grad[BUCKETS] = 0
            g_w += (grad**2).mean(1, keepdims=True)
            weights -= 0.3 * grad / np.sqrt(g_w) + 2e-4 * weights
            seen = np.zeros((n, n))
            starts = np.cumsum(lengths)[:-1]
            inner = np.ones(len(gold) - 1, bool)
            inner[starts - 1] = False
            np.add.at(seen, (gold[:-1][inner], gold[1:][inner]), 1)
            g = expected[0] - seen
            g_m += g**2
            moves -= 0.3 * g / np.sqrt(g_m)
    model.weights, model.moves = weights[:BUCKETS], moves.astype(np.float32)
    return model
