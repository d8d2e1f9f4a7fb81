"""p9: personal information in free text, by weak supervision.

Generous patterns find candidate spans of each type; of names every pair of capitalised words, and words of any case
where a person may be named (after a label, a title, a preposition, at the start of a sentence). Labelers vote on
every candidate (for, against, or nothing): strict formats, words to its left and right, a gazetteer of common given
names, endings of surnames, contact data nearby, and what the corpus tells of its words: how often they stand
where persons introduce themselves, and whether they are otherwise written small. The votes are counted by pattern over
all documents in the cluster, and expectation-maximisation over these counts (their number is bounded by
3 ^ labelers) estimates how reliable each labeler is and how likely each pattern is true. With these as soft
labels a linear classifier over the votes and the neighbouring words is trained, on at most ``SAMPLE`` candidates
(those with the smallest hashes), and decides every candidate. Spans are kept exactly as they stand.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import read_table, through_table

TYPES = ("email", "identity", "phone", "address", "name")  # where spans overlap, the earlier type goes first
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}
SAMPLE, BITS, NEAR = 50_000, 12, 48  # candidates to train on, hashed neighbour words, characters of context

S = r"[^\S\n\r]"  # white space within a line
W = r"\p{L}[\p{L}\p{M}'’]+"
#: Given names that are common in the countries named, as public statistics list them.
COMMON = {
    "US, UK": "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen oliver amelia george isla noah ava jack emily harry sophie",
    "Germany": "peter maria michael sabine thomas susanne andreas petra wolfgang monika klaus ursula stefan anna leon emma paul mia",
    "France": "jean marie pierre nathalie michel isabelle philippe sylvie louis camille gabriel jade",
    "Spain, Latin America": "antonio carmen jose josefa manuel laura francisco ana juan dolores sofia mateo santiago valentina",
    "Italy": "giuseppe rosa giovanni angela mario lucia luigi francesca",
    "Poland, Russia, Ukraine": "jan krzysztof agnieszka piotr katarzyna olga ivan natalia sergei svetlana oleksandr olena",
    "Nordics": "lars anne erik ingrid karin mikael johanna nils",
    "Vietnam": "anh minh huong linh thanh lan tuan hoa",
    "China, Korea, Japan": "wei fang ming min-jun seo-yeon haruto yui sakura kenji",
    "Middle East, South Asia, Africa": "mohammed fatima ahmed aisha omar zeynep mehmet priya rahul anjali ibrahim amina kwame chinedu",
}
GIVEN = set(" ".join(COMMON.values()).split())
#: Endings that mark surnames in many languages.
SURNAME = regex.compile(r"(?:^(?:mc|mac|o['’]|van|von|de)\p{Lu}?\p{L}{3,}|\p{L}{2,}(?:son|sen|sson|mann|berg|stein|meyer|ez|ski|ska|cki|wicz|czyk|chuk|enko|enkov|ov|ova|ev|eva|idis|poulos|oglu|yan|ian|shvili|elli|ini|etti|ese|eau|oux|feld|burg|quist|gren|strom|ström|ford|wood|ton|ley|well|worth|bridge|field|smith))$", regex.I)

STREET = r"(?:street|st|road|rd|avenue|ave|av|lane|ln|drive|dr|boulevard|blvd|crescent|cres|court|ct|close|terrace|way|place|pl|square|sq|row|hill|gardens|mews|parade|highway|hwy)"
UNIT = r"(?:flat|apt|apartment|suite|ste|unit|room|app|apto|piso|wohnung|no|#)"
NUMBER = r"\p{Nd}{1,4}[a-zA-Z]?"

AT = regex.compile(r"[@＠]|at\s?[)\]}]", regex.I)
EMAIL = regex.compile(rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]*(?:{S}?[@＠]{S}?|{S}?[(\[{{]{S}?at{S}?[)\]}}]{S}?)[\p{{L}}\p{{N}}-]+(?:{S}?(?:[.．]|[(\[{{]{S}?dot{S}?[)\]}}]){S}?[\p{{L}}\p{{N}}-]+)+", regex.I)
PHONE = regex.compile(rf"(?<![\p{{L}}\p{{N}}.,/:+-])(?<!\p{{N}}{S})(?:\+{S}?\p{{Nd}}{{1,3}}{S}?)?(?:\({S}?\p{{Nd}}{{1,4}}{S}?\){S}?)?\p{{Nd}}{{1,5}}(?:{S}?\({S}?0{S}?\))?(?:(?:{S}|[-.‑–/]|{S}-{S}|\){S}?)?\p{{Nd}}{{2,6}}){{1,6}}(?:,?{S}*(?:ext|extension|x|durchwahl){S}*\.?{S}*\p{{Nd}}{{1,5}})?(?![\p{{L}}\p{{N}}]|[.,/:-]\p{{N}})", regex.I)
IDENTITY = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}-])(?:\p{{Nd}}{{3}}(?:-\p{{Nd}}{{2}}-|{S}\p{{Nd}}{{2}}{S})\p{{Nd}}{{4}}|\p{{Nd}}{{4}}([-\s])\p{{Nd}}{{4}}\1\p{{Nd}}{{4}}(?:\1\p{{Nd}}{{4}})?|[A-Z]{{2}}{S}?\p{{Nd}}{{2}}{S}?\p{{Nd}}{{2}}{S}?\p{{Nd}}{{2}}{S}?[A-Z]"
    rf"|[A-Z]{{1,2}}\p{{Nd}}{{6,9}}[A-Z]?|[A-Z]\p{{Nd}}{{2}}[A-Z]{{2}}\p{{Nd}}{{5,6}}|\p{{Nd}}{{7,8}}-?[A-Z]|\p{{Nd}}{{9,12}})(?![\p{{L}}\p{{N}}]|[-.]\p{{N}})"
)
ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:(?:{UNIT}\.?{S}*{NUMBER},?{S}+)?{NUMBER},?{S}+(?:(?:north|south|east|west|old|new|upper|lower|great|n|s|e|w)\.?{S}+)?{W}(?:{S}{W})?{S}+{STREET}\b(?:(?<=\p{{L}})\.(?={S}*,))?(?:,{S}*{UNIT}\.?{S}*\p{{N}}+[a-zA-Z]?\b)?"
    rf"|{NUMBER},?{S}+(?:bis{S}+)?(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai)\b{S}+(?:(?:de|du|des|la|le|l['’]){S}*)*{W}(?:-{W})*(?:,{S}*(?:app|apt|bât|étage)\.?{S}*\p{{N}}+)?"
    rf"|{W}(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer){S}+{NUMBER}\b(?:,{S}*(?:wohnung|whg|app)\.?{S}*\p{{N}}+)?"
    rf"|(?:calle|avenida|plaza|paseo|c/|avda\.?|carrer|camino){S}+(?:(?:de|del|la|las|los){S}+)*{W}(?:{S}{W})?,{S}*(?:n[º°o.]{S}*)?{NUMBER}\b(?:,{S}*(?:piso|apto|puerta)?\.?{S}*\p{{N}}+[ºªa-zA-Z]?\b)?)",
    regex.I,
)
PERSON = rf"(?:{W}(?:-{W})?(?:{S}{{1,3}}\p{{L}}\.)?{S}{{1,3}}{W}(?:-{W})?|\p{{L}}\.(?:{S}?\p{{L}}\.)?{S}{{1,3}}{W}(?:-{W})?|{W}(?:-{W})?,{S}{{1,3}}{W}(?:-{W})?(?:{S}\p{{L}}\.)?)"
CAP = r"\p{Lu}[\p{L}\p{M}'’]+"  # a word with a capital
HONORIFIC = rf"(?:\b(?:mr|mrs|ms|miss|mx|dr|prof|herr|frau|señor|señora|sr|sra|mme|monsieur|madame|coach|captain|player|referee){S}*\.?{S}+)"
PART = rf"(?:{S}(?:de|da|di|del|della|dos|van|von|der|den|bin|al|el|la|le){{1,2}})?"
#: Places where persons introduce or sign themselves, or a label announces a name.
INTRO = rf"(?:\b(?:name|full name|nombre|contacto|contact|nom|họ tên|ansprechpartner|kontakt|signed|author|autor|host|player|coach|owner|sender|from|to|attn){S}*[:：]{S}*|\bmy name is{S}+|\bi am{S}+|\bi['’]m{S}+|\bthis is{S}+|\bje m['’]appelle{S}+|\bme llamo{S}+|\bmi nombre es{S}+|\bich heiße{S}+|\bmein name ist{S}+|\btên (?:mình|tôi) là{S}+|\b(?:regards|wishes|greetings|sincerely|truly|faithfully|cheers|yours|grüße|saludos|cordialement),?\s+|\bwritten by{S}+|\bsigned by{S}+|\bcontact{S}+)"
#: Words after which a person may be named.
LEAD = rf"(?:\b(?:by|with|to|from|for|thanks|ask|call|tell|met|meet|and|mit|von|an|bei|par|avec|à|con|por|de|a|với|gặp){S}+)"
RELATION = rf"(?:\b(?:colleague|friend|brother|sister|mother|father|uncle|aunt|cousin|neighbour|neighbor|teacher|manager|boss|assistant|wife|husband|son|daughter|agent|analyst|caster|guest|winner|candidate|nurse|lawyer|tenant|client|customer|kollege|freund|amigo|ami),?{S}+)"
#: What a person does, or what follows a name in contact lines.
DOES = rf"(?:{S}+(?:is|was|has|had|said|says|wrote|writes|asked|told|met|joined|joins|signed|signs|hosted|will|works|worked|lives|lived|moved|called|replied|thinks|won|sent|and i|about)\b|,?{S}*[|;/,(]{S}*(?:tel|phone|mobile|teléfono|e-?mail|mail|correo)\b|{S}*\n{S}*(?:tel|phone|mobile|teléfono|e-?mail|mail|correo)\b|,{S}*(?:je|ich|i|who|aged|née)\b|\s*$)"
AFTER_CUE = regex.compile(rf"(?P<cue>{INTRO}|{RELATION}|{LEAD}|\p{{L}}+{S}*[:：]{S}*)?(?P<title>{HONORIFIC})?(?P<span>{PERSON})(?![\p{{L}}\p{{N}}@＠])", regex.I)
STRONG = regex.compile(rf"{INTRO}|{RELATION}", regex.I)
#: First words of what AFTER_CUE may begin with.
CUES = set(
    "name full nombre contacto contact nom họ ansprechpartner kontakt signed author autor host player coach owner sender from to attn my i this je me mi ich mein tên "
    "regards wishes greetings sincerely truly faithfully cheers yours grüße saludos cordialement written by with for thanks ask call tell met meet and mit von an bei par avec à con por de a và với gặp "
    "colleague friend brother sister mother father uncle aunt cousin neighbour neighbor teacher manager boss assistant wife husband son daughter agent analyst caster guest winner "
    "candidate nurse lawyer tenant client customer kollege freund amigo ami mr mrs ms miss mx dr prof herr frau señor señora sr sra mme monsieur madame captain referee".split()
)
NAME = [
    regex.compile(rf"(?:^|[.!?。！？>\n]\s*)(?P<span>\p{{Ll}}[\p{{L}}'’]+(?:-{W})?(?:{S}{{1,3}}\p{{L}}\.)?{S}{{1,3}}{W}(?:-{W})?)(?![\p{{L}}\p{{N}}@＠])"),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}.@＠_-])(?P<span>{CAP}(?:-{CAP})?(?:{S}\p{{Lu}}\.)?{PART}{S}{{1,3}}{CAP}(?:-{CAP})?|\p{{Lu}}\.(?:{S}?\p{{Lu}}\.)?{S}{{1,3}}{CAP}(?:-{CAP})?|{CAP}(?:-{CAP})?,{S}{{1,3}}{CAP}(?:-{CAP})?(?:{S}\p{{Lu}}\.)?|{CAP}{S}(?i:\L<given>){S}{CAP})(?![\p{{L}}\p{{N}}@＠_])", given=sorted(GIVEN)),
]
#: Cheap patterns without which a text has no candidate of the type.
PREFILTER = {
    "email": AT, "phone": re.compile(r"(?:\d[^\w\n]{0,4}){6}"), "identity": re.compile(r"(?:\d[^\w\n]?){6}|\d\d ?[A-Z]{2} ?\d"),
    "address": regex.compile(rf"\b(?:{STREET}|rue|chemin|impasse|allée|quai|calle|avenida|plaza|paseo|c/|avda|carrer|camino)\b|(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer)\b", regex.I),
}
FINDERS = {"email": EMAIL, "identity": IDENTITY, "phone": PHONE, "address": ADDRESS}
TOKEN = regex.compile(r"[\p{L}\p{M}]+")

YES = {
    "email": regex.compile(r"(?:e-?mail|mail|correo|courriel|send|reach|contact|escr[ií]be|write|mailto|<a)\b[^.!?\n]{0,40}$", regex.I),
    "phone": regex.compile(r"(?:\btel|\bphone|\bcall|whats-?app|\bmobile|\bcell|\bfax|number is|tel[eé]fono|ll[aá]ma|erreichbar|\bruf|handy|\btext|contact|gọi|sđt|\bappelez|t[eé]l[eé]phone)\b[^.!?\n]{0,24}$", regex.I),
    "identity": regex.compile(r"(?:\bssn\b|social|passport|ausweis|\bdni\b|\bnie\b|\bid card|\bid no|\bid document|national|identity|identidad|insurance|\bni (?:number|no)|licen[cs]e|\btax|steuer|cccd|cmnd|personal|reisepass)[^.!?\n]{0,26}$", regex.I),
    "address": regex.compile(r"(?:\bmoved? to|\blives? (?:at|in)|address|\bship|\bmeet|\bsend .{0,20}to|\bdeliver|\bwohn|\btreffen|anschrift|direcci[oó]n|adresse|địa chỉ|\bat\b|\bto\b|:)[^.!?\n]{0,24}$", regex.I),
}
NO = {
    "email": regex.compile(r"(?:ping|meet me)\b[^.!?\n]{0,12}$", regex.I),
    "phone": regex.compile(r"(?:version|patch|\bid\b|lobby|code|bundle|\bskin|range|\bfrom|gold|score|lead|seed|build|deals|order|match|serial|ticket)\b[^.!?\n]{0,20}$", regex.I),
    "identity": regex.compile(r"(?:version|patch|match|lobby|code|bundle|\bskin|range|gold|score|seed|build|replay|order|serial|whatsapp|\btel\b|\bcall|phone|erreichbar|ll[aá]ma)\b[^.!?\n]{0,20}$", regex.I),
    "address": regex.compile(r"(?:minute|level|patch|version|by)\b[^.!?\n]{0,8}$", regex.I),
}
#: Words right before what is no person.
NOT_AFTER = set("against versus vs counter counters beat beats play plays playing main mains build builds buy buys bought the item champion skin ability".split())
YES_AFTER = {
    "email": regex.compile(r"^(?:</a>|[)>\]]|[,;.]?(?:\s|$))"),
    "phone": regex.compile(r"^\s*(?:[|;/]|\n|<|\.?$|\.\s|,? (?:text|or|any ?time|after|before|during))", regex.I),
    "identity": regex.compile(r"^\s*(?:\(|,|\.|\n|<|$)"),
    "address": regex.compile(r"^(?:\.|,|\s*\n|<|$| \p{Lu})"),
    "name": regex.compile(rf"^{DOES}", regex.I),
}
NO_AFTER = {
    "email": regex.compile(r"^\.\p{L}"),
    "phone": regex.compile(r"^\s*(?:units|is a|is on|fixed|valid|,? valid|crashed|minutes?|points|gold|damage|%|[A-Z]\b)", regex.I),
    "identity": regex.compile(r"^\s*,?\s*(?:is a|is on|valid|for one|units|fixed|crashed|points|gold|damage)", regex.I),
    "address": regex.compile(r"^\s*(?:matchup|opponent|phase|wins|deals|damage)", regex.I),
    "name": regex.compile(r"^(?:['’]s\b|[^\S\n\r]*[:：]|\s+(?:deals|counters|answered|waits|gives|grants|inflige|stacks|cancels|builds|costs|hits|from)\b)", regex.I),
}
STRICT = {
    "email": regex.compile(r".*\p{L}{2,}", regex.S),
    "phone": regex.compile(rf"(?:\+{S}?\p{{Nd}}{{1,3}}.*|\(.*|0\p{{Nd}}.*|1[-.\s]\p{{Nd}}{{3}}[-.\s].*|\p{{Nd}}{{3}}([-.\s])\p{{Nd}}{{3}}\1\p{{Nd}}{{4}}.*|\p{{Nd}}{{3}}-\p{{Nd}}{{4}}(?:\D.*)?)", regex.S),
    "identity": regex.compile(r"\d{3}[-\s]\d{2}[-\s]\d{4}|\d{4}([-\s])\d{4}\1\d{4}|[A-Z].*|\d{8}-?[A-Z]"),
    "address": regex.compile(r"(?!.*\b(?:bot|top|mid|middle|deals?|true|the)\b).*", regex.I | regex.S),
    "name": regex.compile(rf"(?:\p{{Lu}}[\p{{L}}'’]*(?:-\p{{Lu}}[\p{{L}}'’]*)?\.?,?{S}*)+"),
}


#: Words that are no part of a person's name.
NO_NAME = set(
    "the a an of from with to by and for is at in on it this that these those there here we you he she they i not no yes if then when while so but or as be are was were "
    "has have had do does did can will would should may must your our his her their its all any some each more most very now one two three "
    "sincerely truly faithfully yours wishes greetings cheers contact thanks regards written coach interview name nombre contacto my me best kind player captain phone tel mail about after before signed record out made "
    "und der die das den dem ein eine ist sind nicht auf bei et le la les un une des du est pour dans sur el los las una es son no se y con von mit ms mr mrs dr herr frau".split()
)
CONTACT = regex.compile(r"[@＠]|\+?\d[\d ().-]{7,}\d|\b(?:tel|phone|mobile|e-?mail|mail|correo|teléfono)\b", regex.I)


EXTENSION = re.compile(r"[^\d\s]*(?:ext|x|durchwahl)", re.I)
DOMAIN = re.compile(r"(?:com|org|net|edu|gov|info|io|de|fr|es|it|vn|uk|eu|example|test|invalid)$", re.I)
APART = re.compile(r"[\s,.-]+")


def gazetteer_vote(kind: str, span: str, about: str) -> int:
    """What the span itself tells: +1, -1 or 0."""
    if kind == "name":
        words = [w.casefold() for w in TOKEN.findall(span)]
        if about and about in words:
            return -1
        return 1 if "." in span or any(w in GIVEN for w in words) else 0
    if kind == "phone":
        main = "".join(c for c in EXTENSION.split(span)[0] if c.isdigit())
        return -1 if not 7 <= len(main) <= 15 or main in "01234567890123456789" or len(set(main)) < 3 else 0
    if kind == "identity":
        return 1 if any(c.isalpha() for c in span) else 0
    if kind == "email":
        return 1 if DOMAIN.search(span) else 0
    return 1 if any(c.isdigit() for c in span) else -1


def votes(kind: str, span: str, left: str, right: str, about: str, cue: bool = False, before: str = "") -> list[int]:
    """One vote a labeler: format, words before (for, against), words after (for, against), gazetteer; of names
    also the ending of a word and contact data nearby."""
    if kind == "name":
        v = [0 if STRICT[kind].fullmatch(span) else -1, int(cue), -int(before in NOT_AFTER)]  # a capital alone says little
    else:
        v = [1 if STRICT[kind].fullmatch(span) else -1, 1 if YES[kind].search(left) else 0, -1 if NO[kind].search(left) else 0]
    v.append(1 if YES_AFTER[kind].match(right) else 0)
    v.append(-1 if NO_AFTER[kind].match(right) else 0)
    v.append(gazetteer_vote(kind, span, about))
    if kind == "name":
        v.append(1 if any(SURNAME.search(w) for w in APART.split(span)) else 0)
        v.append(1 if CONTACT.search(right) else 0)
    return v


def _names(text: str, tokens: list[tuple[int, int]], low: list[str]) -> dict[tuple[int, int], bool]:
    """Spans that may be names, and whether one stands where persons introduce themselves or after a title."""
    spans: dict[tuple[int, int], bool] = {}

    def add(a: int, z: int, cue: bool) -> None:
        if not any(w in NO_NAME for w in TOKEN.findall(text[a:z].casefold()) if len(w) > 1):
            spans[a, z] = spans.get((a, z), False) or cue

    for f in NAME:
        for m in f.finditer(text, overlapped=True):
            add(*m.span("span"), False)
    for (a, z), w in zip(tokens, low, strict=True):
        if (w in CUES or text[z : z + 1] in ":：" and z < len(text)) and (m := AFTER_CUE.match(text, a)):
            cue = m["cue"] or ""
            if cue or m["title"]:
                add(*m.span("span"), bool(m["title"]) or bool(STRONG.fullmatch(cue)))
    by_end = {}  # what follows "Last," is no name without it
    for a, z in spans:
        by_end.setdefault(z, []).append(a)
    return {(a, z): c for (a, z), c in spans.items() if not any(b < a and text[b:a].rstrip().endswith(",") for b in by_end[z])}


def _patterned(kind: str, text: str) -> set[tuple[int, int]]:
    """Spans that may be of a type other than names."""
    if not PREFILTER[kind].search(text):
        return set()
    if kind == "address":  # only around words for streets, up to white space
        parts: list[list[int]] = []
        for m in PREFILTER[kind].finditer(text):
            a, z = text.rfind(" ", 0, max(0, m.start() - 80)) + 1, text.find(" ", m.end() + 60)
            z = len(text) if z < 0 else z
            if parts and a <= parts[-1][1]:
                parts[-1][1] = z
            else:
                parts.append([a, z])
    else:
        parts = [[0, len(text)]]
    spans = set()
    for first, last in parts:
        for m in FINDERS[kind].finditer(text, first, last):
            a, z = m.span()
            if kind == "phone" and text.count("/", a, z) > 1:  # a list of numbers
                continue
            if kind == "phone":  # a number that merely follows is no part of it
                while sum(c.isdigit() for c in text[a:z]) > 20 or sum(c.isdigit() for c in EXTENSION.split(text[a:z])[0]) > 15:
                    cut = text[a:z].split()
                    if len(cut) < 2:
                        break
                    z = a + len(text[a:z].rstrip()[: -len(cut[-1])].rstrip())
            if kind not in ("phone", "identity") or sum(c.isdigit() for c in text[a:z]) >= 6:
                spans.add((a, z))
    return spans


def candidates(text: str | None, about: str | None) -> list[tuple[str, int, int, str, str, list[int]]]:
    """(type, start, end, word before, word after, votes) of every candidate of a text."""
    if not text:
        return []
    about, out = (about or "").casefold(), []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    low, starts = [text[a:z].casefold() for a, z in tokens], [a for a, _ in tokens]
    for kind in TYPES:
        spans = _names(text, tokens, low) if kind == "name" else dict.fromkeys(_patterned(kind, text), False)
        for (a, z), cue in sorted(spans.items()):
            k, n = bisect_left(starts, a) - 1, bisect_left(starts, z)
            before = low[k] if k >= 0 and a - tokens[k][1] < NEAR else ""
            after = low[n] if n < len(low) and starts[n] - z < NEAR else ""
            out.append((kind, a, z, before, after, votes(kind, text[a:z], text[max(0, a - NEAR) : a], text[z : z + NEAR], about, cue, before)))
    return out


SPAN = "doc_id {0}, pii_type string, start int, stop int, pii_text string, word_before string, word_after string, marks string, first_word string, last_word string"


def spans(docs: DataFrame) -> DataFrame:
    """All candidates of docs (doc_id, text, entity_name) with their votes as ``marks`` (one of +-. a labeler)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, text, about in zip(f["doc_id"], f["text"], f["entity_name"], strict=True):
                for k, a, z, b, c, v in candidates(text, about):
                    words = [w for w in TOKEN.findall(text[a:z].lower()) if len(w) > 1] if k == "name" else [""]
                    if "," in text[a:z]:
                        words = words[::-1]
                    rows.append((i, k, a, z, text[a:z], b, c, "".join("-.+"[x + 1] for x in v), words[0] if words else "", words[-1] if words else ""))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "start", "stop", "pii_text", "word_before", "word_after", "marks", "first_word", "last_word"]).astype({"start": "int32", "stop": "int32"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "entity_name").where("text is not null").mapInPandas(run, SPAN.format(kind))


LETTERS = r"[\p{L}\p{M}]+"


def with_corpus_votes(cands: DataFrame, docs: DataFrame) -> DataFrame:
    """cands, of names with four more votes on their first and last words, by counts over all docs.

    A word that often stands where persons introduce themselves speaks for a name, a frequent word that hardly
    ever does against it; so does one that is mostly written small.
    """
    names = cands.where("pii_type = 'name'")
    w = docs.select(F.explode(F.regexp_extract_all("text", F.lit(LETTERS), 0)).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("w") == F.lower("w")).alias("small"))
    own = [names.select(F.col(c).alias("word"), (F.substring("marks", 2, 1) == "+").alias("cue"), F.lit(c).alias("at")) for c in ("first_word", "last_word")]
    cues = own[0].unionByName(own[1]).groupBy("word", "at").agg(F.count_if("cue").alias("cues"))
    share, small = F.col("cues") / F.col("n"), F.col("small") / F.col("n")
    stands = F.when((F.col("cues") > 1) & (share >= 0.1), "+").when((F.col("n") >= 20) & (share < 0.02), "-").otherwise(".")
    case = F.when((F.col("n") >= 5) & (small > 0.5), "-").otherwise(".")
    told = through_table(cues.join(w, "word", "left").select("word", "at", F.concat(stands, case).alias("told")), "p9-words")
    of = lambda c: told.where(F.col("at") == c).select(F.col("word").alias(c), F.col("told").alias(f"{c}_told"))
    more = names.join(of("first_word"), "first_word", "left").join(of("last_word"), "last_word", "left")
    none = F.lit("..")
    more = more.withColumn("marks", F.concat("marks", F.coalesce("first_word_told", none), F.coalesce("last_word_told", none))).select(*cands.columns)
    return more.unionByName(cands.where("pii_type != 'name'"))


def reliabilities(marks: list[str], counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability that each pattern of votes is true, by expectation-maximisation.

    Each labeler has its own chances of the three votes for true and for false spans (naive Bayes); the start is
    the votes' majority, with a span nobody votes for held false. Labelers are held to be no worse than chance: a vote for is at least as likely for true
    spans as for false ones, a vote against at most.
    """
    v = np.array([["-.+".index(c) for c in m] for m in marks]).reshape(len(marks), -1)
    hot = np.eye(3)[v]  # pattern x labeler x vote
    p = 1 / (1 + np.exp(2 - 1.5 * (v - 1).sum(1)))
    for _ in range(rounds):
        yes = (np.einsum("n,nlv->lv", counts * p, hot) + [0.2, 1.0, 2.0]) / ((counts * p).sum() + 3.2)
        no = (np.einsum("n,nlv->lv", counts * (1 - p), hot) + [2.0, 1.0, 0.2]) / ((counts * (1 - p)).sum() + 3.2)
        share = ((counts * p).sum() + 1) / (counts.sum() + 2)
        odds = np.log(yes) - np.log(no)
        odds[:, 0], odds[:, 2] = np.minimum(odds[:, 0], 0), np.maximum(odds[:, 2], 0)
        score = np.log(share / (1 - share)) + np.einsum("nlv,lv->n", hot, odds)
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p


def indices(kind: str, marks: str, before: str, after: str) -> list[int]:
    """Features of a candidate: each vote, the votes together, and its neighbours."""
    names = [f"{kind}|{i}{m}" for i, m in enumerate(marks)] + [f"{kind}|{marks}", f"{kind}|b={before}", f"{kind}|a={after}", kind]
    return [crc32(n.encode()) & ((1 << BITS) - 1) for n in names]


def fit(rows: list[tuple[str, str, str, str]], soft: dict[tuple[str, str], float], epochs: int = 6) -> np.ndarray:
    """Weights of a logistic regression on soft labels; rows are (type, marks, word before, word after)."""
    w, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    if not rows:
        return w
    found = [indices(*r) for r in rows]
    most = max(map(len, found))
    x = np.array([i + [1 << BITS] * (most - len(i)) for i in found])  # the last weight fills short rows and stays 0
    y = np.array([soft[r[0], r[1]] for r in rows])
    order = np.arange(len(x))
    for e in range(epochs):
        np.random.default_rng(e).shuffle(order)
        for at in range(0, len(order), 128):
            i = order[at : at + 128]
            g = 1 / (1 + np.exp(-np.clip(w[x[i]].sum(1), -30, 30))) - y[i]
            total = np.zeros_like(w)
            np.add.at(total, x[i].reshape(-1), np.repeat(g, x.shape[1]))
            seen += total**2
            w -= 0.3 * total / np.sqrt(seen)
            w[-1] = 0
    return w


def found(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, pii_type, start, stop, pii_text of every span judged personal; none overlap.

    Null and empty texts have none. Offsets count characters. Of overlapping spans the earlier type of TYPES
    wins, then the longer, then the first.
    """
    cands = through_table(with_corpus_votes(through_table(spans(docs), "p9-spans"), docs), "p9-votes")
    counted = cands.groupBy("pii_type", "marks").agg(F.count("*").alias("n")).orderBy("pii_type", "marks").collect()
    soft: dict[tuple[str, str], float] = {}
    for kind in TYPES:
        own = [r for r in counted if r["pii_type"] == kind]
        if own:
            p = reliabilities([r["marks"] for r in own], np.array([r["n"] for r in own], float))
            soft |= {(kind, r["marks"]): float(x) for r, x in zip(own, p, strict=True)}
    key = F.xxhash64("doc_id", "start", "stop", "pii_type")
    rows = cands.orderBy(key, "pii_type", "marks", "word_before", "word_after").select("pii_type", "marks", "word_before", "word_after").limit(sample).collect()
    w = fit([tuple(r) for r in rows], soft)

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [w[indices(*r)].sum() >= 0 for r in zip(f["pii_type"], f["marks"], f["word_before"], f["word_after"], strict=True)]
            yield f.loc[keep, ["doc_id", "pii_type", "start", "stop", "pii_text"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    good = cands.mapInPandas(decide, f"doc_id {kind}, pii_type string, start int, stop int, pii_text string")
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("pii_type")).cast("int")
    item = F.struct(rank.alias("rank"), (F.col("start") - F.col("stop")).alias("size"), "start", "stop", "pii_type", "pii_text")
    free = lambda got, x: ~F.exists(got, lambda g: (g["start"] < x["stop"]) & (x["start"] < g["stop"]))
    empty = F.array().cast("array<struct<rank:int,size:int,start:int,stop:int,pii_type:string,pii_text:string>>")
    # the spans of one document, whose number its text bounds
    one = good.groupBy("doc_id").agg(F.array_sort(F.collect_set(item)).alias("all"))
    kept = F.aggregate("all", empty, lambda got, x: F.when(free(got, x), F.concat(got, F.array(x))).otherwise(got))
    return one.select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.pii_type", "s.start", "s.stop", "s.pii_text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(read_table(spark, sf_dir, "documents")).select("doc_id", "pii_type", "pii_text").distinct()


def redacted(docs: DataFrame, spans_: DataFrame) -> DataFrame:
    """doc_id, text with every span replaced by its placeholder, the rest unchanged; null texts stay null."""
    per = spans_.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "pii_type"))).alias("s"))
    # pieces between spans, each followed by its placeholder
    acc = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    step = lambda a, x: F.struct(x["stop"].alias("at"), F.concat(a["text"], F.substring("text", a["at"] + 1, x["start"] - a["at"]), F.lit("["), F.upper(x["pii_type"]), F.lit("]")).alias("text"))
    done = F.aggregate("s", acc, step, lambda a: F.concat(a["text"], F.substring("text", a["at"] + 1, F.length("text"))))
    return docs.select("doc_id", "text").join(per, "doc_id", "left").select("doc_id", F.when(F.col("s").isNull(), F.col("text")).otherwise(done).alias("text"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return redacted(docs, found(docs))


QUERIES = {"p9_found": p9_found, "p9_redacted": p9_redacted}
