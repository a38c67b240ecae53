"""Personal data: exact base patterns, and bootstrapped contextual extraction of identifiers that these miss.

Every base match is a seed, and so is a looser shape inside one ("(017) 555-7713" in "+1 (017) 555-7713"). Looser shapes
elsewhere (addresses written with "(at)", IPv6, digit groups that fail the checks, phone numbers without a plus) are candidates.
A fifth kind, keys, has no base rule: hexadecimal words as long as a digest are its seeds and other long words of letters and
digits its candidates, and either is reported only where a pattern announces it, in columns of its own.

The patterns of a place are the word before it and the two before, the word after it and the two after, and the frame of both
words around it, each with what is glued to it told from what stands apart. They form a graph with the instances. Each round
admits the patterns that announce enough distinct trusted instances and do so often enough, of all the times they occur in the
corpus, scores them by the share of their distinct instances that are trusted, then a candidate by its patterns together. What
becomes trusted admits more patterns in the next round. Trust can only rise, so the rounds end where nothing rises any more.
Patterns of high confidence give their candidates to the result; base matches are never changed by that.

Defined cases: null text counts as empty; positions are code points with the end exclusive; rows that repeat a doc_id are
told apart by their texts, and rows that repeat both get the same spans; a candidate that overlaps a base match is none; kinds
are matched separately, so spans of two kinds may overlap; a word of over ``WORD_CHARS`` characters counts as one and the same
long word in patterns; no seeds means no patterns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright.llm.scratch import discard, sliced, written

KINDS = ("email", "ip", "card", "phone", "key")
#: Kinds from here on have no base rule.
KEY = 4
#: A pattern is used from this share of trusted instances, among one more than it has.
CONFIDENT = 0.9
#: A pattern needs so many distinct trusted instances.
SUPPORT = 5
#: A pattern's occurrences in the whole corpus must announce a trusted instance in at least this share.
SPECIFIC = 0.3
#: So many patterns are counted in one pass over the corpus, which bounds what a task holds.
BLOCK = 50_000
#: Words longer than this are alike, and this many characters on either side hold two words that are not.
WORD_CHARS, REACH = 256, 600
LONG_WORD = "\u2026"
#: Trust that rises by less than this in a whole round ends the rounds.
STEADY = 1e-6

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What stands for "@", and what may follow it.
AT = re.compile(r"@|\(at\)|\[at\]")
HOST = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*+")
IPV6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9A-Za-z])")
KEY_WORD = re.compile(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{16,}+")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})")

_SHAPE = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)} | {i: ord("0") for i in range(ord("1"), ord("9") + 1)}

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        if i % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _around(text: str, mark: re.Pattern, host: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost matches of a local part, a mark and a host, found from each mark outwards, in time linear in the text."""
    out, after = [], 0
    for m in mark.finditer(text):
        if m.start() < after:
            continue
        start = m.start()
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        rest = host.match(text, m.end()) if start < m.start() else None
        if rest:
            out.append((start, rest.end()))
            after = rest.end()
    return out


def emails(text: str) -> list[tuple[int, int]]:
    return _around(text, _MARK, DOMAIN)


_MARK = re.compile("@")


def addresses(text: str) -> list[tuple[int, int]]:
    """Each four parts in a row of a chain of dotted numbers, where none is over 255."""
    out = []
    for chain in DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts = [(m.start(), m.end()) for m in re.compile("[0-9]+").finditer(text, chain.start(), chain.end())]
        for i in range(0, len(parts) - 3, 4):
            four = [text[a:b].lstrip("0") or "0" for a, b in parts[i : i + 4]]
            if all(len(p) <= 3 and int(p) <= 255 for p in four):
                out.append((parts[i][0], parts[i + 3][1]))
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of every base match, kind by kind."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DOTTED.search(text) is None:
        return spans
    spans += [(1, a, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def loose_shapes(text: str) -> list[Span]:
    """(kind, start, end) of every looser shape."""
    out = [(0, a, b) for a, b in _around(text, AT, HOST)] if "@" in text or "at" in text else []
    if DOTTED.search(text) is None:
        return out
    if ":" in text:
        out += [(1, *m.span()) for m in IPV6.finditer(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(_digits(m.group())) <= 19:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in LOCAL_PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    for m in KEY_WORD.finditer(text):
        word = m.group()
        if not word.isdecimal() and any("0" <= c <= "9" for c in word) and any(c.isalpha() for c in word):
            out.append((KEY, *m.span()))
    return out


def graded(text: str, base: list[Span]) -> tuple[list[Span], list[Span]]:
    """Further seeds, which lie within a base match of their kind or are keys of a digest's form, and candidates, which
    overlap no base match."""
    taken: list[list[int]] = []
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    own: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in sorted(base):
        own.setdefault(k, []).append((a, b))
    seeds, candidates = [], []
    for k, a, b in loose_shapes(text):
        at = bisect_right(starts, b - 1) - 1
        if at < 0 or taken[at][1] <= a:
            (seeds if k == KEY and DIGEST.fullmatch(text, a, b) else candidates).append((k, a, b))
        elif k in own:
            i = bisect_right(own[k], (a, len(text) + 1)) - 1
            if i >= 0 and b <= own[k][i][1] and (a, b) != own[k][i]:
                seeds.append((k, a, b))
    return seeds, candidates


def shaped(text: str) -> str:
    """Lower-case A to Z and write every digit as 0."""
    return text.translate(_SHAPE)


def _words(text: str) -> list[str]:
    return [w if len(w) <= WORD_CHARS else LONG_WORD for w in text.split()]


def _beside(text: str, place: int, side: int) -> tuple[list[str], str]:
    """Up to two words before (-1) or after (1) a place, the nearest first, and the blank between, if any."""
    if side < 0:
        low = max(0, place - REACH)
        part, cut = shaped(text[low:place]), low > 0 and not text[low - 1].isspace()
    else:
        high = place + REACH
        part, cut = shaped(text[place:high]), high < len(text) and not text[high].isspace()
    words = part.split()
    far = part[:1] if side < 0 else part[-1:]
    if cut and words and not far.isspace():  # the farthest word goes on outside
        if len(words[0 if side < 0 else -1]) <= WORD_CHARS:
            del words[0 if side < 0 else -1]
    words = [w if len(w) <= WORD_CHARS else LONG_WORD for w in (words[::-1] if side < 0 else words)][:2]
    edge = part[-1:] if side < 0 else part[:1]
    return words, " " if edge.isspace() else ""


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: "<" and the words before, ">" and those after, "=" and both with a bar between.

    A blank next to the place tells a word that stands apart from what is glued to it.
    """
    before, gap = _beside(text, start, -1)
    after, space = _beside(text, end, 1)
    found = [f"<{' '.join(before[:n][::-1])}{gap}" for n in range(1, len(before) + 1)]
    found += [f">{space}{' '.join(after[:n])}" for n in range(1, len(after) + 1)]
    if before and after:
        found.append(f"={before[0]}{gap}|{space}{after[0]}")
    return found


class _Glued:
    """Parts of words by their outer character and length."""

    def __init__(self, parts: set[str], outer: int):
        self.parts, self.lengths = parts, {}
        for c, n in sorted({(p[outer], len(p)) for p in parts if p}):
            self.lengths.setdefault(c, []).append(n)

    def before(self, word: str) -> list[str]:
        return [word[:n] for n in self.lengths.get(word[0], ()) if n < len(word) and word[:n] in self.parts]

    def after(self, word: str) -> list[str]:
        return [word[-n:] for n in self.lengths.get(word[-1], ()) if n < len(word) and word[-n:] in self.parts]


class Wanted:
    """Patterns to count, by their nearest words: whole ones, and glued ones."""

    def __init__(self, wanted: list[str]):
        self.patterns = set(wanted)
        before = [p[1:] for p in wanted if p[0] == "<"]
        after = [p[1:] for p in wanted if p[0] == ">"]
        #: a bar may also be part of a word, so each one may be the one between
        frames = [(p[1:i], p[i + 1 :]) for p in wanted if p[0] == "=" for i in range(1, len(p)) if p[i] == "|"]
        self.lefts, self.rights = {a for a, _ in frames}, {b for _, b in frames}
        self.ends = {p.split()[-1] for p in before if p[-1] == " "}
        self.starts = {p.split()[0] for p in after if p[0] == " "}
        self.prefixes = _Glued({p.split()[-1] for p in before if p[-1] != " "} | {p for p in self.lefts if p and p[-1] != " "}, 0)
        self.suffixes = _Glued({p.split()[0] for p in after if p[0] != " "} | {p for p in self.rights if p and p[0] != " "}, -1)
        #: words that a frame may have before it, and all whole words of patterns
        self.before = {p[:-1] for p in self.lefts if p[-1:] == " "}
        self.whole = self.ends | self.starts


def count_patterns(text: str, wanted: Wanted) -> dict[str, int]:
    """How often each wanted pattern occurs in a text, at the places where ``patterns`` would find it; a frame is counted
    around single words."""
    words, found = _words(shaped(text)), {}
    last = len(words) - 1

    def met(p: str) -> None:
        if p in wanted.patterns:
            found[p] = found.get(p, 0) + 1

    whole, framing, frames = wanted.whole, wanted.before, bool(wanted.lefts)
    heads, tails = wanted.prefixes.lengths, wanted.suffixes.lengths
    before = None
    for i, w in enumerate(words):
        framed, before = before in framing, w
        glued = w[0] in heads
        if not (framed or glued or w in whole or w[-1] in tails):
            continue
        if w in wanted.ends:
            met(f"<{w} ")
            if i:
                met(f"<{words[i - 1]} {w} ")
        if w in wanted.starts:
            met(f"> {w}")
            if i < last:
                met(f"> {w} {words[i + 1]}")
        prefixes = wanted.prefixes.before(w) if glued else ()
        suffixes = wanted.suffixes.after(w) if w[-1] in tails else ()
        for p in prefixes:
            met(f"<{p}")
            if i:
                met(f"<{words[i - 1]} {p}")
        for p in suffixes:
            met(f">{p}")
            if i < last:
                met(f">{p} {words[i + 1]}")
        if frames and (framed or prefixes):
            lefts = [p for p in prefixes if p in wanted.lefts]
            if framed:
                lefts.append(f"{words[i - 1]} ")
            if lefts:
                rights = [p for p in suffixes if p in wanted.rights]
                if i < last and f" {words[i + 1]}" in wanted.rights:
                    rights.append(f" {words[i + 1]}")
                for a in lefts:
                    for b in rights:
                        met(f"={a}|{b}")
    return found


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


OCCURRENCE = "struct<kind:int,start:int,end:int,seed:boolean,instance:string,patterns:array<string>>"
FOUND = f"base string, n_email long, n_ip long, n_card long, n_phone long, seen array<{OCCURRENCE}>"


def with_base(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the base spans, their counts, and every occurrence with its patterns."""
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(FOUND).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    n_own = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                seeds, loose = graded(text, base)
                found[0].append(span_text(base))
                for k in range(KEY):
                    found[k + 1].append(sum(1 for s in base if s[0] == k))
                found[5].append(
                    [
                        {
                            "kind": k,
                            "start": a,
                            "end": b,
                            "seed": seed,
                            "instance": re.sub(r"[\x20().-]", "", text[a:b].lower()) if 0 < k < KEY else text[a:b].lower(),
                            "patterns": patterns(text, a, b),
                        }
                        for spans, seed in ((base, True), (seeds, True), (loose, False))
                        for k, a, b in spans
                    ]
                )
            added = [pa.array(v, fields.field(n_own + i).type) for i, v in enumerate(found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], fields.names)

    return docs.mapInArrow(run, schema)


def corpus_counts(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(pattern, n): how often each of a block of patterns occurs in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        ends = Wanted(shared.value)
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                for p, n in count_patterns(text or "", ends).items():
                    totals[p] = totals.get(p, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["pattern", "n"]
        )

    return docs.select("text").mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def counted(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(pattern, n) of every pattern of ``wanted``, in as many passes over the corpus as there are blocks of them."""
    wanted = written(wanted.select("pattern").distinct(), "pii-wanted")
    blocks = -(-wanted.count() // BLOCK)
    counts = None
    for k in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()
        some = written(corpus_counts(docs, [r["pattern"] for r in block]), "pii-counts")
        counts = some if counts is None else counts.union(some)
    return wanted.withColumn("n", F.lit(0).cast("long")) if counts is None else counts


def reachable(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, pattern, corpus): those that would be admitted if all their instances were trusted, with their counts.

    No round can admit another one, so the rest of the graph is never looked at. A pattern counts at least as often as it
    announces a seed or a candidate, also where these are of several words and a frame around them is not counted.
    """
    most = edges.groupBy("kind", "pattern").agg(F.count("*").alias("support"), F.sum("n").alias("places"))
    most = written(most.where(F.col("support") >= SUPPORT), "pii-support")
    corpus = F.greatest("places", F.coalesce("n", F.lit(0))).alias("corpus")
    every = most.join(counted(most, docs), "pattern", "left").select("kind", "pattern", "places", corpus)
    return every.where(F.col("places") >= SPECIFIC * F.col("corpus")).select("kind", "pattern", "corpus")


def confident_patterns(seen: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored patterns (kind, pattern, confidence, support) and instances (kind, instance, trust) of occurrences.

    A pattern's confidence is the trust of its distinct instances over one more than their number; a candidate's trust
    is the chance that one of its confident patterns is right. Seeds are trusted from the start, candidates once their
    trust is that of a confident pattern. Every quantity can only rise from round to round, so the loop ends.
    """
    edges = seen.select("kind", "instance", "seed", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = written(edges, "pii-edges")
    whole, edges = edges, written(edges.join(reachable(edges, docs), ["kind", "pattern"]), "pii-graph")
    discard(whole)
    trust = edges.groupBy("kind", "instance").agg(F.max("seed").cast("double").alias("trust"))
    sure = F.col("trust") >= CONFIDENT
    before = last = None
    while True:
        scores = edges.join(trust, ["kind", "instance"]).groupBy("kind", "pattern", "corpus")
        scores = scores.agg(
            (F.sum("trust") / (F.count("*") + 1)).alias("confidence"),
            F.sum("trust").alias("support"),
            F.count_if(sure).alias("known"),
            F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("announced"),
        )
        admitted = (F.col("known") >= SUPPORT) & (F.col("announced") >= SPECIFIC * F.col("corpus"))
        scores = scores.where(admitted & (F.col("confidence") >= 0.5)).select("kind", "pattern", "confidence", "support")
        scores = written(scores, "pii-patterns")
        discard(last)
        last = scores
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(1 - 1e-9))))
        graded = edges.join(scores, ["kind", "pattern"], "left").groupBy("kind", "instance")
        graded = graded.agg(F.max("seed").alias("seed"), doubt.alias("doubt"))
        known = F.when(F.col("seed"), 1.0).otherwise(1 - F.exp(F.coalesce("doubt", F.lit(0.0))))
        old, trust = trust, written(graded.select("kind", "instance", known.alias("trust")), "pii-instances")
        discard(old)
        n_sure, total = trust.agg(F.count_if(sure), F.coalesce(F.sum("trust"), F.lit(0.0))).first()
        state = (scores.count(), n_sure, total)
        if before and state[:2] == before[:2] and state[2] - before[2] < STEADY:
            return scores, trust
        before = state


def discovered(seen: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, key, added): the spans that confident patterns add to each text, as a list."""
    scores, trust = confident_patterns(seen, docs)
    sure = scores.where(F.col("confidence") >= CONFIDENT).select("kind", "pattern")
    candidates = seen.where(f"not seed or kind >= {KEY}").join(
        trust.where(F.col("trust") >= CONFIDENT).select("kind", "instance"), ["kind", "instance"], "left_semi"
    )
    places = candidates.select("doc_id", "key", "kind", "start", "end", F.explode("patterns").alias("pattern"))
    places = places.join(sure, ["kind", "pattern"], "left_semi")
    span = F.struct("kind", "start", "end")
    return places.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(span)).alias("added"))


def _occurrences(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "key", F.inline("seen"))


def _joined(rows: DataFrame, added: DataFrame) -> DataFrame:
    """Rows with their added spans; Spark broadcasts that table while it is small."""
    there = added.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "added")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    return rows.join(there, same, "left").drop("_id", "_key")


def _named(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, the base spans and all spans, as text, for each row."""
    rows = written(with_base(_keyed(docs.select("doc_id", "text"))).drop("text"), "pii-base")
    rows = _joined(rows, written(discovered(_occurrences(rows), docs), "pii-added"))
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    added = F.filter(F.coalesce("added", none), lambda s: s["kind"] < KEY)
    keys = F.filter(F.coalesce("added", none), lambda s: s["kind"] >= KEY)
    every = F.concat(base, _named(added))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    sortable = F.transform(
        every,
        lambda s: F.struct(
            F.array_position(kinds, F.split_part(s, F.lit(":"), F.lit(1))),
            F.split_part(s, F.lit(":"), F.lit(2)).cast("int"),
            s.alias("span"),
        ),
    )
    ordered = F.transform(F.sort_array(sortable), lambda s: s["span"])
    return rows.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.array_join(ordered, ",").alias("spans"),
        F.size(added).cast("long").alias("n_added"),
        F.size(keys).cast("long").alias("n_key"),
        F.array_join(_named(keys), ",").alias("keys"),
        (F.size(every) + F.size(keys)).cast("long").alias("n_found"),
    )


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of the first."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in text replaced by its kind, and n_chars, where there is one, set anew.

    Occurrences are written once; the texts are then scanned again, which costs less than moving them.
    """
    own = docs.columns
    keyed = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    seen = with_base(docs.select("doc_id", "text", keyed)).where("size(seen) > 0").select("doc_id", "key", "seen")
    added = written(discovered(_occurrences(written(seen, "pii-seen")), docs), "pii-added")
    whole = docs.select("doc_id", keyed, F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"))
    rows = _joined(whole, added).select("_row.*", F.col("added").alias("_added"))
    schema = docs.schema
    place = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("_added").to_pylist(), strict=True):
                spans = base_spans(text or "") + [(s["kind"], s["start"], s["end"]) for s in more or []]
                texts.append(redact_text(text, spans) if spans else text)
            columns = [batch.column(k) for k in range(len(own))]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, own)

    done = rows.mapInArrow(run, schema)
    if "n_chars" in own:
        done = done.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return done


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
