"""Writing-style features of texts, as column expressions, and all at once in one pass over Arrow batches.

Each expression walks the tokens of a text by itself, which is right for a few of them; ``measured`` takes all features from one
count of a text's distinct tokens, at about a tenth of the cost.

Tagged parts of speech need a trained tagger, which is not at hand: ``tag_ratios`` goes by closed word classes and endings
instead, in the order of ``CLASSES``, and takes what is left as nouns. The rules are for English.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2, sqrt

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words by language, which also decide the language of a text.
STOP_WORDS = {
    "en": "the of and to in is that it was for on are as with his they at be this from have or by not but what all were when".split(),
    "fr": "le la les de des du et un une en est que qui dans pour pas sur au par avec ne se ce il sont plus ou".split(),
    "de": "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er".split(),
    "es": "el la los las de que y en un una es se no con por para su al lo como del mas pero sus le ya".split(),
    "it": "il lo la i gli le di che e un una per non con si da del della in sono come ma al dei nel anche piu".split(),
    "pt": "o a os as de que e em um uma para com nao se por mais como mas ao dos das foi seu sua ou no na".split(),
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als bij maar dan naar door over".split(),
}
#: Word classes in the order in which they are tried: words, and endings that follow two characters or more.
CLASSES = {
    "determiner": ("the a an this that these those every each some any".split(), None),
    "pronoun": ("i you he she it we they me him her us them my your his its our their mine yours ours theirs".split(), None),
    "conjunction": ("and or but nor so yet".split(), None),
    "numeral": ("one two three four five six seven eight nine ten hundred thousand million".split(), None),
    "preposition": ("of to in for on with at by from into over under about after before between through without".split(), None),
    "adverb": ("very not never always often also too just only soon here there now well again".split(), ["ly"]),
    "verb": ("is are was were be been am has have had do does did can will would should could may might must".split(), ["ing", "ed", "ise", "ize", "ify"]),
    "adjective": ("good new high low small large big great best better fast easy light".split(), ["ous", "ful", "less", "able", "ible", "ive", "ical", "ic", "ish"]),
}
#: Tokens with a digit are numerals as well.
DIGIT = r"\p{Nd}"
#: Comparatives and superlatives (words, and endings that follow three characters or more), and verbs that open a request.
DEGREES = ("more most less least better best worse worst further furthest".split(), ["er", "est"])
NO_DEGREES = "other after under over never ever number water paper power order user another later either rather whether winter summer test rest best".split()
REQUESTS = "use try buy get see make take keep add click order choose enjoy discover find learn check follow read place set turn press let stop start call visit".split()


def tokens(text: Column) -> Column:
    """Words and single marks, in order; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.trim(text), r"(?<=[.!?])\s+", "\u0001"), "\u0001")
    return F.filter(parts, lambda s: F.trim(s) != "")


def _count(items: Column, rule) -> Column:
    return F.size(F.filter(items, rule)).cast("double")


def punctuation_entropy(text: Column) -> Column:
    """Bits of the distribution of punctuation marks; 0 without any."""
    marks = F.regexp_extract_all(text, F.lit(r"(?U)[^\w\s]"), F.lit(0))
    n = F.size(marks).cast("double")
    each = F.transform(F.array_distinct(marks), lambda m: _count(marks, lambda x: x == m) / n)
    return F.when(n > 0, -F.aggregate(each, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(F.lit(0.0))


def _singles(words: Column) -> Column:
    """How many distinct words occur once, from one pass over the sorted words."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("once"))

    def step(state: Column, word: Column) -> Column:
        same = state["last"].eqNullSafe(word)
        ended = (~same & (state["run"] == 1)).cast("int")
        return F.struct(word.alias("last"), F.when(same, state["run"] + 1).otherwise(F.lit(1)).alias("run"), (state["once"] + ended).alias("once"))

    return F.aggregate(F.sort_array(words), start, step, lambda s: s["once"] + (s["run"] == 1).cast("int"))


def features(text: Column) -> dict[str, Column]:
    """Name and expression of each feature; blank texts have zeros throughout."""
    words, parts = tokens(text), sentences(text)
    low, alpha = F.transform(words, lambda w: F.lower(w)), F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))
    lengths = F.transform(parts, lambda s: F.size(tokens(s)).cast("double"))
    n, n_parts = F.greatest(F.size(words), F.lit(1)).cast("double"), F.greatest(F.size(lengths), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    mean = F.aggregate(lengths, F.lit(0.0), lambda a, v: a + v) / n_parts
    squares = F.aggregate(lengths, F.lit(0.0), lambda a, v: a + v * v) / n_parts
    spread = F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0)))
    letters = F.aggregate(alpha, F.lit(0.0), lambda a, w: a + F.length(w))
    distinct = F.size(F.array_distinct(words))
    marks = F.regexp_count(text, F.lit(r"(?U)[^\w\s]")).cast("double")
    found = {
        "avg_sentence_length": mean,
        "std_sentence_length": spread,
        "max_sentence_length": F.coalesce(F.array_max(lengths), F.lit(0.0)),
        "type_token_ratio": distinct / n,
        "hapax_ratio": _singles(words) / F.greatest(distinct, F.lit(1)),
        "stopword_ratio": _hits(low, STOP_WORDS["en"]) / n,
        "avg_word_length": F.when(F.size(alpha) > 0, letters / F.size(alpha)).otherwise(F.lit(0.0)),
        "long_word_ratio": _count(alpha, lambda w: F.length(w) > 6) / n,
        "uppercase_ratio": _count(alpha, lambda w: (F.length(w) > 1) & w.rlike(r"^\p{Lu}+$")) / n,
        "capitalized_ratio": _count(alpha, lambda w: w.rlike(r"^\p{Lu}\p{Ll}*$")) / n,
        "digit_token_ratio": _count(words, lambda w: w.rlike(DIGIT)) / n,
        "punctuation_entropy": punctuation_entropy(text),
        "punctuation_ratio": marks / chars,
        "exclamation_ratio": F.regexp_count(text, F.lit("!")) / n_parts,
        "question_ratio": F.regexp_count(text, F.lit(r"\?")) / n_parts,
        "comma_ratio": F.regexp_count(text, F.lit(",")) / n_parts,
    }
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return {k: F.when(blank, F.lit(0.0)).otherwise(v.cast("double")) for k, v in found.items()}


def _hits(low: Column, known: list[str]) -> Column:
    return _count(low, lambda w: w.isin(*known))


def language(text: Column) -> Column:
    """The language with the most of its function words in a text; English for short and undecided ones."""
    low = F.transform(tokens(text), lambda w: F.lower(w))
    votes = F.array(
        *[
            F.struct(_hits(low, known).alias("n"), F.lit(-i).alias("place"), F.lit(code).alias("code"))
            for i, (code, known) in enumerate(STOP_WORDS.items())
        ]
    )
    best = F.array_max(votes)
    return F.when(best["n"] > 0, best["code"]).otherwise(F.lit("en"))


def _is(word: Column, rule: tuple[list[str], list[str] | None], before: int = 2) -> Column:
    """Whether a word in lower case is of a class: one of its words, or an ending after so many characters."""
    found = word.isin(*rule[0])
    for ending in rule[1] or ():
        found = found | (word.endswith(ending) & (F.length(word) >= len(ending) + before))
    return found


def tagged(words: Column) -> Column:
    """array<string>: the class of each word, a mark's being "mark"."""

    def tag(word: Column) -> Column:
        word = F.lower(word)
        out = F.when(~word.rlike(r"[\p{L}\p{Nd}]"), "mark")
        for name, rule in CLASSES.items():
            out = out.when(_is(word, rule) | word.rlike(DIGIT) if name == "numeral" else _is(word, rule), name)
        return out.otherwise("noun")

    return F.transform(words, tag)


def _equals(name: str):
    # a function of one parameter: a second one would be given the place in the array
    return lambda tag: tag == name


def tag_ratios(words: Column) -> dict[str, Column]:
    """The share of tokens in each class, and of comparatives and superlatives."""
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    low = F.transform(words, lambda w: F.lower(w))
    tags = tagged(words)
    found = {name: _count(tags, _equals(name)) / n for name in (*CLASSES, "noun")}
    degree = lambda w: _is(w, DEGREES, 3) & ~w.isin(*NO_DEGREES)
    return found | {"comparative_superlative": _count(low, degree) / n}


def imperative_ratio(text: Column) -> Column:
    """Requests a sentence: verbs of a request at its start, after a comma or after a conjunction."""
    said = F.transform(sentences(text), tokens)
    before = [*CLASSES["conjunction"][0], ","]

    def requests(sentence: Column) -> Column:
        opens = lambda w, i: F.lower(w).isin(*REQUESTS) & ((i == 0) | F.lower(F.get(sentence, i - 1)).isin(*before))
        return F.size(F.filter(sentence, opens))

    total = F.aggregate(said, F.lit(0), lambda a, s: a + requests(s))
    return F.coalesce(total / F.greatest(F.size(said), F.lit(1)), F.lit(0.0))


def unigrams_and_bigrams(text: Column) -> Column:
    words = F.filter(F.transform(tokens(text), lambda w: F.lower(w)), lambda w: w.rlike(r"(?U)\w"))
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) > 1, F.concat(words, two)).otherwise(words)


# ---- all features in one pass ----

_WORD = r"\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}"  # what (?U)\w is in the expressions
_TOKEN = regex.compile(rf"[{_WORD}]+|[^{_WORD}\s]")
# the same for characters up to the end of Latin letters, where plain ranges say it and the plain engine is faster
_LATIN = "A-Za-z0-9_\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_LATIN_TOKEN, _BEYOND = re.compile(rf"[{_LATIN}]+|[^{_LATIN}\t-\r \x85\xa0]"), re.compile("[^\x00-\u024f]")
_BREAK = re.compile(r"(?<=[.!?])[ \t\n\x0B\f\r]+")
_FORMS = {k: regex.compile(p) for k, p in (("alpha", r"\p{L}+"), ("upper", r"\p{Lu}+"), ("capital", r"\p{Lu}\p{Ll}*"), ("mark", rf"[^{_WORD}\s]"))}
_SOME = regex.compile(r"[\p{L}\p{Nd}]")
_DIGIT = regex.compile(DIGIT)
_STOPS = {c: frozenset(words) for c, words in STOP_WORDS.items()}
_OPENERS = frozenset(REQUESTS)
_BEFORE = {*CLASSES["conjunction"][0], ","}
#: Features that are counts over tokens, by what is counted.
TAGS = (*CLASSES, "noun")
NAMES = (
    "avg_sentence_length", "std_sentence_length", "max_sentence_length", "type_token_ratio", "hapax_ratio", "stopword_ratio", "avg_word_length",
    "long_word_ratio", "uppercase_ratio", "capitalized_ratio", "digit_token_ratio", "punctuation_entropy", "punctuation_ratio", "exclamation_ratio",
    "question_ratio", "comma_ratio", *[f"{t}_ratio" for t in TAGS], "comparative_superlative_ratio", "imperative_ratio",
)


_ORDER = {name: k for k, name in enumerate(CLASSES)}
_LISTED: dict[str, int] = {}
for _name, _rule in CLASSES.items():
    for _w in _rule[0]:
        _LISTED.setdefault(_w, _ORDER[_name])
_ENDED = [(k, tuple(rule[1])) for k, rule in enumerate(CLASSES.values()) if rule[1]]
_DEGREE_WORDS, _DEGREE_ENDS, _NO_DEGREE = frozenset(DEGREES[0]), tuple(DEGREES[1]), frozenset(NO_DEGREES)
_SAID_IN = {w: tuple(i for i, words in enumerate(_STOPS.values()) if w in words) for words in _STOPS.values() for w in words}


def _ends(low: str, endings: tuple[str, ...], before: int) -> bool:
    return low.endswith(endings) and any(low.endswith(e) and len(low) >= len(e) + before for e in endings)


def _class(low: str, digit: bool) -> int:
    """The first class that a word is in, by its list, its ending or its digits; the last number is that of nouns."""
    found = _LISTED.get(low, len(CLASSES))
    if digit:
        found = min(found, _ORDER["numeral"])
    for k, endings in _ENDED:
        if k < found and _ends(low, endings, 2):
            return k
    return found


@lru_cache(maxsize=1 << 16)
def _known(token: str) -> tuple:
    """What a token adds to a text's features each time it occurs; the class is -1 for what has neither letter nor digit."""
    low = token.lower()
    if token.isascii():
        alpha, some = token.isalpha(), token.isalnum() or token.strip("_") != ""
        upper, capital = alpha and token.isupper(), alpha and token[0].isupper() and (len(token) == 1 or token[1:].islower())
        digit = not alpha and any("0" <= c <= "9" for c in token)
        mark = len(token) == 1 and not token.isalnum() and token != "_"
        some = some and not mark
    else:
        alpha, upper, capital, mark = (bool(_FORMS[k].fullmatch(token)) for k in ("alpha", "upper", "capital", "mark"))
        digit, some = bool(_DIGIT.search(token)), bool(_SOME.search(token))
    degree = (low in _DEGREE_WORDS or _ends(low, _DEGREE_ENDS, 3)) and low not in _NO_DEGREE
    return alpha, len(token), upper, capital, digit, mark, _class(low, digit) if some else -1, degree, _SAID_IN.get(low, ()), low in _OPENERS


def style_of(text: str) -> tuple[str, list[float]]:
    """The language and ``NAMES`` of a text."""
    token = _TOKEN if _BEYOND.search(text) else _LATIN_TOKEN
    said = [token.findall(s) for s in _BREAK.split(text.strip(" ")) if s.strip(" ")]
    if not said:
        return "en", [0.0] * len(NAMES)
    counts: Counter[str] = Counter()
    for s in said:
        counts.update(s)
    n, lengths = max(counts.total(), 1), [len(s) for s in said]
    alpha = letters = long = upper = capital = digit = degrees = marks = 0
    tags, stops, entropy, asks = [0] * len(TAGS), [0] * len(_STOPS), [], False
    for token, k in counts.items():
        is_alpha, size, is_upper, is_capital, has_digit, is_mark, tag, degree, langs, request = _known(token)
        if is_alpha:
            alpha += k
            letters += size * k
            long += k * (size > 6)
            upper += k * (size > 1 and is_upper)
            capital += k * is_capital
        digit += k * has_digit
        degrees += k * degree
        if is_mark:
            marks += k
            entropy.append(k)
        if tag >= 0:
            tags[tag] += k
        for i in langs:
            stops[i] += k
        asks = asks or request
    opened = sum(t.lower() in _OPENERS and (i == 0 or s[i - 1].lower() in _BEFORE) for s in said for i, t in enumerate(s)) if asks else 0
    mean = sum(lengths) / len(lengths)
    best = max(range(len(stops)), key=lambda i: (stops[i], -i))
    parts = len(said)
    values = [
        mean, sqrt(max(sum(x * x for x in lengths) / parts - mean * mean, 0.0)), float(max(lengths)), len(counts) / n,
        sum(k == 1 for k in counts.values()) / max(len(counts), 1), stops[0] / n, letters / alpha if alpha else 0.0, long / n, upper / n, capital / n,
        digit / n, -sum(k / marks * log2(k / marks) for k in entropy) if marks else 0.0, marks / max(len(text), 1), text.count("!") / parts,
        text.count("?") / parts, text.count(",") / parts, *[t / n for t in tags], degrees / n, opened / parts,
    ]
    return list(STOP_WORDS)[best] if stops[best] else "en", values


def measured(rows: DataFrame, text: str) -> DataFrame:
    """Rows with the text replaced by its language and ``NAMES``; null and blank texts have zeros throughout."""
    own = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [style_of(t or "") for t in part.column(text).to_pylist()]
                values = [pa.array([v[k] for _, v in found], pa.float64()) for k in range(len(NAMES))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], pa.array([c for c, _ in found], pa.string()), *values], [*own, "language", *NAMES])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in own], "language string", *[f"{n} double" for n in NAMES]]))
