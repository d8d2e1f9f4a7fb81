"""p2: defective answers, by a multi-label linear classifier on hashed n-grams and pair features.

The classifier is trained here, on a bounded sample of the answers at hand (``SAMPLE`` pairs, the first by a hash
of their ids) and on defects made from them: emptied, cut off at any place, replaced by a refusal, by the question
or by an answer in another language; answers swapped within a language stand for what is none of these. Features
are hashed, and all serve every label: word n-grams of the answer without names and numbers, its last words, and
pair features (how it ends in its layout, what it adds to the question, languages of both,
whether another was asked for, what ``rag_meta`` says) with their conjunctions. Thresholds are calibrated for
each label on a part of the sample held out, where the made defects are known. Every answer is scored.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import chat
from loomwright.llm.leaks import INLINE, TAG
from loomwright.session import read_table, through_table

LABELS = ("empty", "truncated", "refusal", "copy", "language")
REFUSAL = LABELS.index("refusal")
#: Untouched answers that score above SUSPECT aren't learnt from as good ones; refusals above SURE are learnt as such.
SUSPECT, SURE = np.where(np.arange(len(LABELS)) == REFUSAL, -4.0, -1.0), 0.0
#: Weight of an untouched answer for the models that look for suspects, as no wording is known not to be a refusal.
GOOD = 0.05
BITS, SAMPLE, EPOCHS, SEED = 17, 10_000, 6, 7

#: Frequent words of languages in Latin script.
FREQUENT = {
    "en": "the and is of to a in for with you are it what how does do when on at not this that your from be or can which who i as they if then",
    "de": "der die das und ist in den mit zu von für nicht ein eine auf dem wie bei aus bis hat sich du ich mir man ohne nach bitte oder zuerst wird",
    "fr": "le la les des du et est de un une dans pour avec sur que qui au il ne pas vous à en quel quels moi sans dès son sa ou l d",
    "es": "el la los las de y es en un una con por para que se no del al qué cómo cuál quién mi le hay sin su o tengas desde está",
    "vi": "của là và có khi cho không được trong bao với để này ở đã nào trước hay mình giữa sau thì đang lâu từ xuống rồi mới hãy đừng",
    "pt": "o os as de e é em um uma com por para que se não do da ao como qual quem mais você sem seu sua ou está foi na no",
    "it": "il lo gli di e è in un una con per che non del della al come quale chi più sono senza suo sua o dei nel questo quando alla",
}
#: Scripts that tell a language, by a character class.
SCRIPTS = {"ko": r"\p{Hangul}", "ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}", "ru": r"\p{Cyrillic}", "ar": r"\p{Arabic}", "th": r"\p{Thai}", "el": r"\p{Greek}", "hi": r"\p{Devanagari}", "he": r"\p{Hebrew}"}
#: Names of languages as a question may give them.
CALLED = {
    "en": "english englisch anglais inglés ingles tiếng anh inglese", "de": "german deutsch allemand alemán aleman tiếng đức tedesco",
    "fr": "french französisch français francais francés frances tiếng pháp", "es": "spanish spanisch espagnol español espanol tiếng tây ban nha",
    "vi": "vietnamese vietnamesisch vietnamien vietnamita tiếng việt", "pt": "portuguese portugiesisch portugais portugués português", "it": "italian italienisch italien italiano",
    "ko": "korean koreanisch coréen coreano tiếng hàn 한국어", "ja": "japanese japanisch japonais japonés tiếng nhật 日本語", "zh": "chinese chinesisch chinois chino tiếng trung 中文 mandarin", "ru": "russian russisch russe ruso tiếng nga русском русский",
}
WORDS = {k: set(v.split()) for k, v in FREQUENT.items()}
SCRIPT = {k: regex.compile(v) for k, v in SCRIPTS.items()}
FOREIGN = regex.compile("|".join(SCRIPTS.values()))
NAMES = {n: k for k, v in CALLED.items() for n in v.split() if n != "tiếng"}
MARKS = {"vi": regex.compile(r"[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]", regex.I), "de": regex.compile("[äöüß]", regex.I), "es": regex.compile("[ñ¿¡]", regex.I), "fr": regex.compile("[çêèœîû]", regex.I), "pt": regex.compile("[ãõ]", regex.I)}
TOKEN = regex.compile(r"[\p{L}\p{M}'’]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]")
ALIKE = regex.compile(r"\p{Han}|[[\p{L}\p{M}\p{N}]--\p{Han}]+", regex.V1)
NOTHING = {"none", "null", "nan", "undefined", "nil", "na", "n a", "empty"}

#: Parts of refusals, by language: openings, the refusal itself, endings. Written for training.
REFUSALS = {
    "en": (
        ["", "", "Sorry, ", "I'm sorry, but ", "I am sorry. ", "Unfortunately, ", "Unfortunately ", "Hmm. ", "Apologies, ", "As a game assistant, ", "As an AI, ", "Oh no, ", "Thanks for asking, but ", "Well, "],
[f"{who} {what} {topic}" for who in ("I can't", "I cannot", "I won't", "I will not", "I am not able to", "I'm unable to", "I'm not going to", "I must refuse to", "I have to decline to", "I'd rather not", "I prefer not to", "I am not allowed to", "it would not be appropriate for me to", "I don't feel comfortable trying to") for what in ("answer", "help with", "assist with", "give advice on", "be giving any advice about", "discuss", "talk about", "respond to", "go into", "comment on", "provide information on") for topic in ("this", "that", "this topic", "that request", "this question", "this one")]
        + [f"{what} {how} {scope}" for what in ("this", "that", "answering this", "your question", "the topic") for how in ("is outside", "is beyond", "lies outside", "is not within") for scope in ("what I may discuss", "what I'm allowed to answer", "what I can talk about", "what I am here for", "my scope")]
        + [f"{what} is something I {must} {do}" for what in ("this", "that") for must in ("have to", "must", "need to") for do in ("decline", "refuse", "leave unanswered")] 
        + 40 * ["I can't help with that request", "that is something I have to decline", "this lies outside what I may discuss", "I won't give any advice on this topic", "I cannot help with this", "I am not able to answer this one", "I'm unable to answer that question", "I must refuse to go into this", "I have to decline this question", "I'd rather not respond to that", "I would rather not answer", "it would not be appropriate for me to answer", "I don't feel comfortable answering", "I won't answer this", "I can't assist with that", "I can't discuss that", "answering this is beyond what I may do", "I don't think I should answer this"],
        [".", ".", " at this time.", ", thank you for understanding.", ". Please ask me something else.", ". Is there another champion you would like to know about?", ". Maybe try a different question.", " right now."],
    ),
    "de": (
        ["", "Leider ", "Tut mir leid, ", "Entschuldigung, ", "Es tut mir leid, aber ", "Als Assistent "],
        ["dabei kann ich nicht helfen", "kann ich dir dabei nicht helfen", "das kann ich nicht beantworten", "darf ich das nicht beantworten", "das möchte ich nicht beantworten", "diese Frage möchte ich nicht beantworten", "diese Frage beantworte ich nicht", "darauf darf ich nicht antworten", "ich darf darauf nicht antworten", "diese Frage muss ich ablehnen", "dazu kann ich nichts sagen", "ich kann diese Anfrage nicht beantworten", "darüber spreche ich lieber nicht"],
        [".", ".", " im Moment.", ". Frag mich bitte etwas anderes.", ", danke für dein Verständnis."],
    ),
    "fr": (
        ["", "Désolé, ", "Pardon, ", "Malheureusement, ", "Je suis désolé, mais ", "Je regrette, ", "En tant qu'assistant, "],
        ["je ne peux pas vous aider sur ce point", "je ne peux pas répondre à cette question", "je ne suis pas autorisé à répondre", "je préfère ne pas répondre", "je préfère ne pas répondre à cette question", "je dois refuser cette demande", "je ne suis pas en mesure de répondre", "il m'est impossible de répondre à cela"],
        [".", ".", " pour le moment.", ". Posez-moi une autre question.", ", merci de votre compréhension."],
    ),
    "es": (
        ["", "Lo siento, ", "Disculpa, ", "Lo siento, pero ", "Lamentablemente, ", "Perdona, ", "Como asistente, "],
        ["no puedo ayudarte con eso", "no puedo responder a esa pregunta", "prefiero no contestar esa pregunta", "no estoy autorizado a responder", "debo rechazar esta petición", "no me es posible responder", "no soy capaz de contestar esto"],
        [".", ".", " por ahora.", ". Pregúntame otra cosa.", ", gracias por entenderlo."],
    ),
    "vi": (
        ["", "Xin lỗi, ", "Rất tiếc, ", "Tiếc là ", "Xin lỗi bạn, ", "Là trợ lý, "],
        ["mình không thể giúp việc này", "mình không được phép trả lời", "mình không thể trả lời câu hỏi này", "mình xin phép không trả lời", "tôi phải từ chối yêu cầu này", "mình không tiện trả lời câu này", "mình xin từ chối trả lời câu này", "mình từ chối trả lời"],
        [".", ".", " lúc này.", ". Bạn hỏi câu khác nhé.", ", cảm ơn bạn đã hiểu."],
    ),
}
BLANKS = ["", " ", "​", "\n\n", "\t  ", "   ", "...", "…", "-", "--", '""', "''", "<p></p>", "<br>", "&nbsp;", "None", "null", "N/A", "nan", "[]", "{}", ".", "?", "*"]
TAILS = {"en": ["and after that you should", "because the enemy will", "so that your", "which means the"], "de": ["und danach solltest du", "weil der"], "fr": ["et ensuite vous", "parce que le"], "es": ["y después de eso", "porque el"], "vi": ["và", "vì đội"]}


def plain(text: str | None) -> str:
    """Text as shown: without tags and blank entities."""
    t = text or ""
    if "<" in t:
        t = TAG.sub(" ", INLINE.sub("", t))
    return t.replace("&nbsp;", " ").replace("&#160;", " ")


def language(text: str) -> str:
    """Code of the language most of the text is in; '' if it doesn't tell."""
    for k, p in SCRIPT.items() if FOREIGN.search(text) else ():
        if len(p.findall(text)) >= max(2, 0.15 * sum(c.isalpha() for c in text)):
            return k
    low = [w for w in ALIKE.findall(text.replace("'", " ").replace("’", " ")) if w[:1].islower() or len(text) < 60]
    low = [w.lower() for w in low]
    score = {k: sum(w in v for w in low) for k, v in WORDS.items()}
    for k, p in () if text.isascii() else MARKS.items():
        score[k] += min(len(p.findall(text)), 1 + len(low) // 4)
    first, second = sorted(score.items(), key=lambda x: -x[1])[:2]
    return first[0] if first[1] and first[1] > second[1] else ""


def asked_for(question: str) -> set[str]:
    """Languages the question names."""
    return {NAMES[w] for w in ALIKE.findall(question.lower()) if w in NAMES}


def layout(text: str) -> str:
    lines = text.strip().split("\n")
    if "```" in text:
        return "code"
    if lines[0].lstrip().startswith("|"):
        return "table"
    if len(lines) > 1:
        if any(regex.match(r"\s*\d+[.)]", x) for x in lines[1:]):
            return "numbers"
        if any(regex.match(r"\s*[-*•–]", x) for x in lines[1:]):
            return "bullets"
    return "prose"


def ending(text: str) -> str:
    t = regex.sub(r"(?:[\s\p{Cf}\p{So}]|[🏻-🏿])+$", "", text)
    if not t:
        return "none"
    if t.count("```") % 2:
        return "fence"
    if t.endswith(("...", "…")):
        return "dots"
    if regex.search(r"(?:^|\n)\s*(?:\d+[.)]|[-*•–])$", t):
        return "marker"
    bare = regex.sub(r"[\"'”’»)\]]+$", "", t) or t
    c = bare[-1]
    if c in ".!?。！？؟":
        return "stop"
    if len(bare) < len(t):
        return "closed"
    return "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in "|,;:>-–—(/`" else "other"


def _bucket(n: int) -> str:
    return str(n) if n < 5 else "5" if n < 9 else "9" if n < 20 else "20"


def context(meta: str | None) -> str:
    """What rag_meta says of the passages found: none, empty, some, or unreadable."""
    try:
        x = json.loads(meta or "null")
        x = json.loads(x) if isinstance(x, str) else x
    except ValueError:
        return "bad"
    found = x.get("rag_contexts") if isinstance(x, dict) else None
    return "none" if found is None else "some" if found else "empty"


def features(question: str | None, answer: str | None, meta: str | None) -> tuple[list[int], list[int]]:
    """Indices of the pair features and of the n-grams, with those at the end marked."""
    q, a = plain(question), plain(answer)
    qw = [w.lower() for w in ALIKE.findall(q)]
    words = ALIKE.findall(a.replace("'", "").replace("’", ""))
    aw = [w.lower() for w in words]
    if not aw or " ".join(aw) in NOTHING:
        return [crc32(b"silent") & ((1 << BITS) - 1)], []
    lq, la = language(q), language(a)
    pair = "unknown" if not lq or not la else "same" if lq == la else "asked" if la in asked_for(q) else "other"
    here = set(qw) | {w.replace("'", "").replace("’", "") for w in q.lower().split()}
    added = sum(w not in here for w in aw)
    cover = int(4 * sum(w in set(aw) for w in qw) / max(1, len(qw)))
    gram = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    g, h = gram(" ".join(qw)), gram(" ".join(aw))
    dice = int(10 * 2 * len(g & h) / max(1, len(g) + len(h))) if max(len(aw), len(qw)) < 4 * min(len(aw), len(qw)) + 4 else 0
    shape, end, size = layout(a), ending(a), _bucket(len(aw))
    names = [f"end={shape}|{end}|{min(int(size), 5) if shape == 'prose' else 0}|{dice > 7}", f"langs={pair}|{int(size) >= 5}|{dice > 7}"]
    names += [f"added={_bucket(added)}|{cover}", f"dice={dice}|{_bucket(added)}|{min(len(qw), 3)}", f"size={size}", f"meta={context(meta)}"]
    masked = ["#" if w.isdigit() else "@" if w[:1].isupper() and k and not w.isupper() else w.lower() for k, w in enumerate(words)]
    grams = sorted({f"w{k}=" + " ".join(masked[i : i + k]) for k in (1, 2, 3) for i in range(len(masked) - k + 1)})
    grams += [f"t{k}=" + " ".join(masked[-k:]) for k in (1, 2, 3)]
    index = lambda x: [crc32(n.encode()) & ((1 << BITS) - 1) for n in x]
    return index(names), index(grams)


def damage(rng: random.Random, label: str, q: str, a: str, others: dict[str, list[str]]) -> str | None:
    """The answer with a defect; None where it can't be made."""
    if label == "empty":
        return rng.choice(BLANKS)
    if label == "refusal":
        lang = language(q) if language(q) in REFUSALS else "en"
        head, core, tail = (rng.choice(x) for x in REFUSALS[lang])
        if not head or head.endswith(". ") and rng.random() < 0.5:
            core = core[:1].upper() + core[1:]
        if rng.random() < 0.2:
            tail = tail.replace(".", "!", 1)
        return (head.replace(", ", ": ") if rng.random() < 0.1 else head) + core + tail
    if label == "copy":
        words = q.split()
        if not words:
            return None
        if rng.random() < 0.4 and len(words) > 2:
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(words))
                w = words[k]
                i = rng.randrange(len(w))
                words[k] = rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :], w[:i] + rng.choice("aeioustr") + w[i + 1 :]]) or w
            return " ".join(words)
        return rng.choice([q, q, q.upper(), q.lower(), f"  {q}\n", f"{q} {q}", f"You asked: {q}", f"> {q}", f"Question: {q}\nAnswer: {q}", f'"{q}"', f"You want to know: {q}", q.rstrip("?!. ")])
    if label == "language":
        mine = language(q)
        rest = [k for k in others if k != mine and k not in asked_for(q)]
        return rng.choice(others[rng.choice(sorted(rest))]) if mine and rest else None
    if not a or ending(a) not in ("stop", "fence", "|", "`", "letter", "other", "digit") or len(a) < 20:
        return None
    shape = layout(a)
    if shape == "prose":
        if ending(a) != "stop":
            return None
        cut = a[: rng.randrange(max(8, len(a) // 6), len(a) - 1)]
        if rng.random() < 0.5:
            cut = cut.rsplit(" ", 1)[0]
        cut = cut.rstrip(" .!?。！？")
        roll = rng.random()
        if roll < 0.12:
            cut += rng.choice(["...", "…", " …"])
        elif roll < 0.24 and language(a) in TAILS:
            cut = a + " " + rng.choice(TAILS[language(a)])
        return cut if ending(cut) != "stop" else None
    if shape in ("bullets", "numbers"):
        lines = a.strip().split("\n")
        if rng.random() < 0.6:
            lines = [x if not regex.match(r"\s*[-*•–]\s", x) else regex.sub(r"^\s*[-*•–]", f"{k}.", x) for k, x in enumerate(lines)]
        keep = rng.randrange(1, len(lines))
        mark = regex.match(r"\s*(?:\d+[.)]|[-*•–])", lines[keep])
        return "\n".join([*lines[:keep], mark[0] if mark else ""])
    cut = a[: rng.randrange(len(a) // 3, len(a) - 4)]
    return cut if ending(cut) in ("fence", "digit", "letter") else None


class Model:
    """Weights of hashed features for all labels, one table for pair features and one for n-grams, and thresholds."""

    def __init__(self, narrow: bool = False) -> None:
        """``narrow``: n-grams count for refusals only, so that the other labels can't learn single answers by heart."""
        self.weights = np.zeros((2 << BITS, len(LABELS)), "float32")  # pair features, then n-grams
        self.narrow = np.array([narrow and k != "refusal" for k in LABELS])
        self.limits = np.zeros(len(LABELS))

    @staticmethod
    def pack(items: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Features of many answers in compressed rows: all indices, and where each row begins. No row is empty."""
        rows = [[*p, *(g + (1 << BITS) for g in n)] for p, n in items]
        sizes = np.array([len(r) for r in rows], "int64")
        return np.concatenate([np.array(r, "int64") for r in rows]) if rows else np.empty(0, "int64"), np.cumsum(sizes) - sizes

    def score(self, packed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """One row of scores an answer: the product of its features with the weights, for all answers at once."""
        index, starts = packed
        return np.add.reduceat(self.weights[index], starts) if len(starts) else np.empty((0, len(LABELS)), "float32")

    def fit(self, data: tuple, epochs: int = EPOCHS, good: float = 1.0) -> "Model":
        """Logistic regression of each label by AdaGrad over batches; answers without any label weigh ``good`` for refusals."""
        (index, starts), y = data
        weight = np.ones_like(y)
        weight[~y.any(1), REFUSAL] = good
        ends = np.r_[starts[1:], len(index)]
        seen, order = np.full(self.weights.shape, 0.5, "float32"), np.arange(len(starts))
        for epoch in range(epochs):
            np.random.default_rng(SEED + epoch).shuffle(order)
            for at in range(0, len(order), 256):
                i = order[at : at + 256]
                sizes = ends[i] - starts[i]
                begin = np.cumsum(sizes) - sizes
                part = index[np.repeat(starts[i] - begin, sizes) + np.arange(sizes.sum())]
                g = 1 / (1 + np.exp(-np.clip(self.score((part, begin)), -30, 30))) - y[i]
                g *= weight[i]
                uniq, back = np.unique(part, return_inverse=True)
                by = np.argsort(back, kind="stable")
                total = np.add.reduceat(np.repeat(g, sizes, 0)[by], np.searchsorted(back[by], np.arange(len(uniq))))
                seen[uniq] += total**2
                self.weights[uniq] -= 0.5 * total / np.sqrt(seen[uniq]) + 1e-4 * self.weights[uniq]
                self.weights[1 << BITS :, self.narrow] = 0
        return self

    def calibrate(self, data: tuple) -> "Model":
        """For each label the middle of the thresholds of the best F1 (within 0.001) against all rows of other labels."""
        packed, y = data
        score = self.score(packed)
        for k in range(len(LABELS)):
            good, rest = score[y[:, k] == 1, k], score[y[:, k] == 0, k]
            if not len(good) or not len(rest):
                continue
            grid = np.unique(np.r_[good, 0.0])
            hits, false = len(good) - np.searchsorted(np.sort(good), grid), len(rest) - np.searchsorted(np.sort(rest), grid)
            f1 = 2 * hits / (hits + false + len(good))
            best = grid[f1 >= f1.max() - 0.001]
            self.limits[k] = (best.min() + best.max()) / 2
        return self

    def predict(self, pairs: list[tuple[str | None, str | None, str | None]]) -> list[str | None]:
        """For each question, answer and meta the label that is furthest above its threshold, if any."""
        above = self.score(self.pack([features(*p) for p in pairs])) - self.limits
        return [LABELS[k] if row[k] >= 0 else None for row, k in zip(above, above.argmax(1), strict=True)] if pairs else []


def train(rows: list[tuple[int, str | None, str | None, str | None]]) -> Model:
    """A model from pairs (id, question, answer, meta).

    The untouched answers stand for good ones, but hold defects of their own. So they are split in two, each
    half is judged by a narrow model of the other; what looks defective is left out of the final fit, and sure
    refusals, whose wordings have no end, come with their label.
    """
    rng = random.Random(SEED)
    rows = sorted(rows, key=lambda r: r[0])
    rng.shuffle(rows)
    others: dict[str, list[str]] = {}
    for _, _, a, _ in rows:
        lang = language(a or "")
        if lang and len(a) > 30:
            others.setdefault(lang, []).append(a)
    others = {k: v for k, v in others.items() if len(v) >= 3}
    items = []
    for n, (_, q, a, meta) in enumerate(rows):
        items.append((*features(q, a, meta), [0] * 5, n, False))
        for k in rng.sample(range(5), 2):
            bad = damage(rng, LABELS[k], q or "", a or "", others)
            if bad is not None:
                items.append((*features(q, bad, meta), [int(i == k) for i in range(5)], n, True))
        if (mine := language(q or "")) in others and rng.random() < 0.2:  # another answer of the language is none of the defects
            items.append((*features(q, rng.choice(others[mine]), meta), [0] * 5, n, False))

    def packed(part: list) -> tuple:
        return Model.pack([i[:2] for i in part]), np.array([i[2] for i in part], "float32").reshape(-1, len(LABELS))

    clean = []
    for h in (0, 1):
        mine, others_ = ([i for i in items if i[3] % 2 == side] for side in (h, 1 - h))
        judge = Model(narrow=True).fit(packed(others_), 4, GOOD)
        for i, score in zip(mine, judge.score(packed(mine)[0]), strict=True):
            if i[4] or (score <= SUSPECT).all():
                clean.append(i)
            elif score.argmax() == REFUSAL and score.max() > SURE:
                clean.append((*i[:2], [int(k == REFUSAL) for k in range(len(LABELS))], i[3], True))
    clean.sort(key=lambda i: (i[3], i[4]))
    return Model().fit(packed([i for i in clean if i[3] % 5])).calibrate(packed([i for i in clean if not i[3] % 5]))


def answer_pairs(messages: DataFrame) -> DataFrame:
    """id, q, a, meta: assistant messages directly after a user message of their session, system ones skipped.

    Rows without session or time stand in no order; a role that can't be told is neither and parts what stands
    around it. Repeated rows of an id count once.
    """
    rows = chat.normalised(messages).where("role != 'system' and id is not null").dropDuplicates(["id"])
    pairs = chat.with_previous(rows, ["role", "content"]).where("role = 'assistant' and prev_role = 'user'")
    return pairs.select("id", F.col("prev_content").alias("q"), F.col("content").alias("a"), F.col("rag_meta").alias("meta"))


def defects(pairs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """answer_id, defect of every pair (id, q, a, meta) that is defective. Null and empty answers are ``empty``.

    The model is fitted on at most ``sample`` pairs, kept by the smallest hashes of ids.
    """
    rows = [tuple(r) for r in pairs.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    model = train(rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = model.predict(list(zip(f["q"], f["a"], f["meta"], strict=True)))
            out = pd.DataFrame({"answer_id": f["id"], "defect": pd.Series(got, index=f.index, dtype="object")})
            yield out[out["defect"].notna()]

    return pairs.mapInPandas(run, "answer_id bigint, defect string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(through_table(answer_pairs(read_table(spark, sf_dir, "lol_chat_messages")), "p2-pairs"))


def p2_defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("n"))


QUERIES = {"p2_found": p2_found, "p2_defect_counts": p2_defect_counts}
