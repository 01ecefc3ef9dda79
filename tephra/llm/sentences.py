"""Sentence units of documents in many languages and scripts, by cascading segmentation rules."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    """Whether a position breaks, if ``before`` matches right before it and ``after`` right after it."""

    breaks: bool
    before: str
    after: str


def _abbreviations(words: str, after: str) -> Rule:
    """No break after one of ``words`` and its full stop."""
    return Rule(False, rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(regex.escape(w) for w in words.split())})\.", after)


ANY, LOWER, UPPER, DIGIT = r"\s", r"\s+\p{Ll}", r"\s+[\p{Lu}\p{Lt}]", r"\s+\p{Nd}"

#: Rule tables; in each the first rule that matches decides, a position none matches goes on to the next table.
TABLES: dict[str, list[Rule]] = {
    # Identifiers such as sda1 keep their lower case at the beginning of a sentence.
    "names": [
        Rule(False, r"(?<![\p{L}\p{N}])(?:vs|cf|Cf|p|pp|fig|chap|cap)\.", ANY),
        Rule(True, r"[.!?…]+[\p{Pe}\p{Pf}\"]*", r"\s+\p{Ll}+\p{Nd}+(?![\p{L}\p{N}])"),
    ],
    "en": [
        _abbreviations("Dr Mr Mrs Ms Prof Rev Hon St Gen Col Sgt Capt Lt Jr Sr vs Messrs", ANY),
        _abbreviations("i.e e.g al cf viz approx incl resp ca Ltd Inc Co Corp a.m p.m etc", LOWER),
        _abbreviations("p pp fig figs sect sec ch chap vol para art eq app no nos ed", r"\s+(?:\p{Nd}|[\p{Lu}](?![\p{L}\p{N}])|[IVXLC]+(?![\p{L}\p{N}]))"),
        Rule(False, r"(?<=[\p{L}\p{N},;:(]\s+)Nos?\.", DIGIT),
        Rule(False, r"(?<![\p{L}\p{N}])(?:\p{L}\.){2,}", LOWER),
    ],
    "de": [
        _abbreviations("Dr Prof Hr Fr Hrn St Nr Abb Abs Kap Art Bd Tab Ziff Tel bzw ca vgl Vgl sog geb Dipl Ing lt Mio Mrd evtl ggf inkl zzgl", ANY),
        _abbreviations("z u d i o s a v", r"\s+(?:\p{L}{1,2}\.|a\.|B\.)"),
        Rule(False, r"(?<![\p{L}\p{N}])(?:u\.\s*a|z\.\s*B|d\.\s*h|u\.\s*U|i\.\s*d\.\s*R|o\.\s*ä|v\.\s*a)\.", ANY),
        _abbreviations("usw etc", LOWER),
        _abbreviations("Co", r"\s+KG"),
        _abbreviations("S", DIGIT),
        Rule(False, r"(?<![\p{L}\p{N}])(?:[Aa]m|[Vv]om|[Zz]um|[Bb]eim|[Ii]m|[Bb]is|[Aa]b|[Ss]eit|[Dd]e[rmns]|[Dd]ie|[Dd]as|[Jj]ede[rsmn]?|[Ii]hre?r?|[Ss]eine?r?)\s+\p{Nd}{1,3}\.", UPPER),
        Rule(False, r"(?<!\p{Nd})\p{Nd}{1,2}\.", r"\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert)(?!\p{L})"),
    ],
    "fr": [
        _abbreviations("M MM Mme Mlle Dr Me Pr Éts Ets St Ste chap env fig figs p pp art vol réf tél av bd c.-à-d cf Cf n° éd", ANY),
        _abbreviations("etc", LOWER),
    ],
    "es": [
        _abbreviations("Sr Sra Srta Sres Dr Dra D Dña Cía Ud Uds Vd fig figs pág págs cap art vol aprox núm tel Cf cf Prof Av", ANY),
        Rule(False, r"(?<![\p{L}\p{N}])p\.", r"\s+ej"),
        Rule(False, r"(?<![\p{L}\p{N}])p\.\s+ej\.", ANY),
        _abbreviations("etc h", LOWER),
    ],
    "ar": [_abbreviations("د أ م ص ج ت هـ", ANY)],
    "hi": [
        Rule(False, r"[।?!][”’\"»)]+", r"\s+\S"),
        _abbreviations("डॉ श्री प्रो पं सु कु", ANY),
        Rule(True, r"[।॥?!…]+", ANY),
    ],
    # Scripts without spaces: what closes a quotation or bracket goes on unless a line or the text ends there.
    "cjk": [
        Rule(False, r"(?:…|\.\.\.)", r"\s*(?:と|って)"),
        Rule(False, r"[。！？｡!?…][\p{Pe}\p{Pf}”’\"]+", ""),
        Rule(False, r"(?<![。！？]…?)(?<!…)…", r"(?!\s)"),
        Rule(True, r"(?:[。！？｡]|……)+…*", ""),
    ],
    # A space ends a sentence, but within a run of Latin words it is one of theirs.
    "th": [
        Rule(False, r"(?<!\S)[\p{Latin}\p{N}\p{P}]+", r"[ \t\u00a0]+\p{Latin}"),
        Rule(True, r"\S", r"[ \t\u00a0]"),
    ],
    "cyrillic": [
        _abbreviations("г гг т тт стр рис табл см ср им ул д корп кв проф акад др пр гл ст", r"\s+[\p{Nd}\p{Lu}«]"),
        _abbreviations("г гг тыс млн млрд руб коп др пр е д п к т", LOWER),
        Rule(False, r"(?<![\p{L}\p{N}])т\.", r"\s+(?:е|д|п|к|н)\."),
    ],
    "greek": [
        _abbreviations("π.χ δηλ κ κα βλ σελ αρ πρβλ κεφ εικ", ANY),
        _abbreviations("κ.λπ κ.ά κτλ", LOWER),
        Rule(True, r"[;\u037e][\p{Pe}\p{Pf}\"]*", ANY),
    ],
    "hangul": [],
    "common": [
        Rule(False, r"(?<![\p{L}\p{N}])[\p{Lu}]\.", r"\s+\p{Lu}"),
        # Sentences that follow each other without a space.
        Rule(True, r"(?:[\p{L}\p{N}][\p{Ll}\p{N}]|[ap]\.m|\))(?<!(?<!\p{L})(?:Dr|Mr|Mrs|Ms|Prof|Sr|Sra|Dra|Éts|Cía|Nr|St))[.!?…]+", r"\p{Lu}(?:[\p{Ll}'’\s]|\.[\s\p{Lu}])"),
        Rule(True, r"\p{L}\p{Ll}[.!?…]+", r"[¿¡«“‘„(]"),
        Rule(False, r"(?:\.\.+|…)", LOWER),
        Rule(False, r"[.!?…؟][\p{Pe}\p{Pf}\p{Pi}\"\s]*", r"\s*\p{Ll}"),
        Rule(True, r"[.!?…؟。！？।॥۔։።།။។៕]+[\p{Pe}\p{Pf}\p{Pi}\"\s]*", ANY),
    ],
}

_LATIN = ["names", "en", "de", "fr", "es", "common"]
#: Which tables a passage goes through: by its language where function words tell it, else by its script. Latin words
#: within another script, or without function words, may be of any of the languages.
CASCADES = {
    **{language: ["names", language, "common"] for language in ("en", "de", "fr", "es")},
    "latin": _LATIN,
    **{script: [script, *_LATIN] for script in ("ar", "hi", "cjk", "th", "cyrillic", "greek", "hangul")},
}

#: Words that tell the languages of the Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and to in is was were are it that for with on as at by from this not had has which be or an after before only while when did does why who what see",
    "de": "der die das und ist nicht ein eine einen dem den des von zu mit auf für im wurde wird sind war als auch nach bei aus wer wie wo wann um dass noch nur bitte",
    "fr": "le la les des un une et est dans pour sur avec ne pas que qui du au aux par ce cette sont été plus ou où à il elle voir pourquoi l d qu",
    "es": "el la los las un una y es en que de del para con por se no su al lo como más fue está son qué quién cuándo",
}

_MARK = regex.compile(r"[.!?…؟]+|[。！？｡।॥][。！？｡।॥!?…]*|[۔։።།။។៕]+")
_GREEK_MARK = regex.compile(r"[;\u037e]")
_THAI_GAP = regex.compile(r"(?<=\S)[ \t\u00a0]+(?=\S)")
_PAIR = regex.compile(r"[()\[\]（）［］【】「」『』《》〈〉“”„‘’‚«»\"]")
_CLOSES = {")": "(", "]": "[", "）": "（", "］": "［", "】": "【", "」": "「", "』": "『", "》": "《", "〉": "〈"}
_OPENS = frozenset("([（［【「『《〈„‚‘")
_TAIL = regex.compile(r"[\p{Pe}\p{Pf}\p{Pi}\"\s]*")
_UNIT_LINE = regex.compile(r"\s*(?:#+ |[-*] |\d+\. |\d{4}-\d\d-\d\d[T ]\d\d:\d\d)")
_FENCE = regex.compile(r"\s*(```+|~~~+)")
#: Scripts, and what a letter of theirs counts against one of the Latin script, which needs more of them for a word.
_SCRIPTS = {"th": 2, "cjk": 3, "hi": 1, "ar": 1, "cyrillic": 1, "greek": 1, "hangul": 2, "latin": 1}
_SCRIPT_RUNS = regex.compile(r"(\p{Thai}+)|([\p{Han}\p{Hiragana}\p{Katakana}]+)|(\p{Devanagari}+)|(\p{Arabic}+)|(\p{Cyrillic}+)|(\p{Greek}+)|(\p{Hangul}+)|(\p{Latin}+)")
_WORD = regex.compile(r"\p{Latin}+")
_LANGUAGES_OF: dict[str, list[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _LANGUAGES_OF.setdefault(_word, []).append(_language)


def script_of(text: str) -> str:
    """The script that most of the letters are of."""
    if text.isascii():
        return "latin"
    names, total = list(_SCRIPTS), [0] * len(_SCRIPTS)
    for m in _SCRIPT_RUNS.finditer(text):
        total[m.lastindex - 1] += m.end() - m.start()
    return max(zip((n * _SCRIPTS[s] for n, s in zip(total, names)), (-i for i in range(len(names))), names))[2] if any(total) else "latin"


def language_of(text: str) -> str | None:
    """The language most function words of a Latin text are of; None if none leads."""
    seen: dict[str, int] = {}
    for word in _WORD.findall(text.lower()):
        for language in _LANGUAGES_OF.get(word, ()):
            seen[language] = seen.get(language, 0) + 1
    best = sorted(seen.items(), key=lambda x: -x[1])[:2]
    return best[0][0] if best and (len(best) < 2 or best[0][1] > best[1][1]) else None


@cache
def _decider(cascade: str) -> tuple[regex.Pattern, tuple[bool, ...]]:
    """One pattern for a cascade; the number of the group that matches names the rule."""
    rules = [r for name in CASCADES[cascade] for r in TABLES[name]]
    return regex.compile("|".join(rf"((?<={r.before})(?={r.after}))" for r in rules)), tuple(r.breaks for r in rules)


def _enclosed(text: str) -> list[tuple[int, int]]:
    """Outermost stretches inside matching quotation marks or brackets."""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}
    spans: list[tuple[int, int]] = []

    def close(depth: int, end: int) -> None:
        start = stack[depth][1]
        for opened, _ in stack[depth:]:
            waiting[opened] -= 1
        del stack[depth:]
        while spans and spans[-1][0] > start:
            spans.pop()
        spans.append((start, end))

    def opens(ch: str, at: int) -> None:
        stack.append((ch, at))
        waiting[ch] = waiting.get(ch, 0) + 1

    for m in _PAIR.finditer(text):
        ch, at = m.group(), m.start()
        if ch in _OPENS:
            opens(ch, at)
            continue
        if ch in _CLOSES:
            wanted = (_CLOSES[ch],)
        elif ch == "”":
            wanted = ("“", "„")
        elif ch == "“":
            wanted = ("„",)
        elif ch == "’":
            wanted = ("‘", "‚")
        elif ch == "»":
            wanted = ("«",)
        elif ch == "«":
            wanted = ("»",)
        else:
            wanted = ('"',)
        if any(waiting.get(w) for w in wanted):
            close(next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] in wanted), at + 1)
        elif ch in '“«»"':
            opens(ch, at)
    return spans


def _passage(text: str, base: int, out: list[tuple[int, int]], whole: Callable[[], str | None]) -> None:
    """Sentences of a run of lines between blank lines; ``whole`` tells the language of the document, if a passage doesn't."""
    script = script_of(text)
    pattern, breaks = _decider((language_of(text) or whole() or script) if script == "latin" else script)
    spans = _enclosed(text)
    starts = [s for s, _ in spans]
    begin, size, last = 0, len(text), len(text.rstrip())

    def cut(at: int) -> None:
        nonlocal begin
        piece = text[begin:at]
        lead = len(piece) - len(piece.lstrip())
        if lead < len(piece):
            out.append((base + begin + lead, base + begin + len(piece.rstrip())))
        begin = at

    places = [(m.start(), m.end()) for m in _MARK.finditer(text)]
    if script == "th":
        places = sorted(places + [(m.start(), m.start()) for m in _THAI_GAP.finditer(text)])
    elif script == "greek":
        places = sorted(places + [(m.start(), m.end()) for m in _GREEK_MARK.finditer(text)])
    for start, end in places:
        if end < begin:
            continue
        i = bisect_right(starts, start) - 1
        if i >= 0 and start < spans[i][1]:
            close = spans[i][1]
            if start == end or _TAIL.match(text, end, close).end() != close:
                continue
            end = close
        else:
            while end < size and text[end] in "”’»)]）」』》":
                end += 1
        if end >= last:
            continue
        m = pattern.match(text, end)
        if m and breaks[m.lastindex - 1]:
            cut(end)
    cut(size)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and end (exclusive) of every sentence unit of ``text``, in code points."""
    out: list[tuple[int, int]] = []
    at, run, fence = 0, None, None
    whole = cache(lambda: language_of(text))

    def flush(end: int) -> None:
        nonlocal run
        if run is not None:
            _passage(text[run:end], run, out, whole)
        run = None

    def unit(line: str, begin: int) -> None:
        bare = line.strip()
        if bare:
            lead = begin + len(line) - len(line.lstrip())
            out.append((lead, lead + len(bare)))

    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence is not None:
            unit(line, at)
            if mark and mark.group(1).startswith(fence):
                fence = None
        elif mark:
            flush(at)
            fence = mark.group(1)
            unit(line, at)
        elif not line.strip():
            flush(at)
        elif _UNIT_LINE.match(line):
            flush(at)
            unit(line, at)
        elif run is None:
            run = at
        at += len(line) + 1
    flush(len(text))
    return out


def sentences(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, start_pos, end_pos of every sentence unit of every text.

    Ordered break and no-break rule pairs decide each position after a closing mark (in Thai each space):
    the language of a passage, told by its function words, or else the script of most of its letters picks a
    cascade of tables, and the first rule that matches decides. Time is linear in the text. Blank lines end
    a unit; headings, list items, dated lines and lines of a fenced block are units; marks within quotation
    marks or brackets belong to the sentence around them. The language column is not trusted.

    A map without shuffle, a batch of rows at a time. Defined results: NULL, empty and blank texts have no
    rows; a repeated row gives its units again; a text without any mark is one unit per passage, however
    long; a quotation that is never closed within its passage doesn't count as one; an unclosed fence runs to
    the end. Other columns are never read.
    """
    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text")
            row, lo, hi = [], [], []
            for i, t in enumerate(texts):
                t = t.as_py()
                if not t:
                    continue
                for a, b in sentence_spans(t):
                    row.append(i)
                    lo.append(a)
                    hi.append(b)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int32())), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["key", "start_pos", "end_pos"])

    return rows.mapInArrow(run, f"key {kind}, start_pos long, end_pos long").withColumnRenamed("key", key)
