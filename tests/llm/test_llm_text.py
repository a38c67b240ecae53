"""Text operators against brute force on a small table with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricewright.llm import chat, components, fingerprints, katz, mixing, pii, pieces, quality, segmentations, simhash, token_counts

WORDS = "the of and to in is that it was for on are as with his they at be this from".split()


def text_of(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


TEXTS = [
    "", None, "one", "Two words", text_of(1, 5), text_of(1, 5), text_of(2, 60), text_of(2, 60) + " tail", text_of(3, 400), "x" * 3000,
    "  lead\tand\ntrail  ", "É à Ünïcode ▁ mark 日本 text", "mail a.b@c.de, x@y and +1 (017) 555-7713 from 10.0.0.255",
    "card 4539 1488 0343 6467 or 4539148803436466; 1.2.3.4.5.6.7.8 999.1.1.1", text_of(4, 2000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sketch string, score double, rank int, fp long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or ""), "clash", 0.5, 7, 9, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- fingerprints ----


def brute_sketch(spark_hash, text):
    w = words(text)
    runs = [w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else []
    hashes = {spark_hash(tuple(r)) for r in runs}
    bound = -(2**63) + int(fingerprints.FRACTION * 2**64)
    low = sorted(h for h in hashes if h <= bound)
    return low or sorted(hashes)[:1]


def chained(run):
    seed = 42
    for w in run:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def test_fingerprints_match_brute_force(docs):
    got = fingerprints.compare_edited(docs).collect()
    rows = sorted([(r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()])
    assert len(got) == len(rows)
    expected = Counter()
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (brute_sketch(chained, t) for t in (text, edited, after))
        near = lambda x, y: len(set(x) & set(y)) / min(len(x), len(y)) if min(len(x), len(y)) else float(len(x) == len(y))
        expected[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(map(str, a)), ",".join(map(str, b)), near(a, b), near(a, c))] += 1
    assert Counter((-1 if r.doc_id is None else r.doc_id, *r[1:7]) for r in got) == expected


def test_merged_sketches_are_those_of_both_texts(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 90, n)) for n in rng.integers(0, 9, 120)]
    pairs = spark.createDataFrame([(a, b) for a in texts[:40] for b in texts[40:80]], "a string, b string")
    for fraction in (0.5, 0.05):
        rows = fingerprints.with_sketch(fingerprints.with_sketch(pairs, "a", "x", fraction=fraction), "b", "y", fraction=fraction)
        bound = -(2**63) + int(fraction * 2**64)
        for r in rows.withColumn("z", fingerprints.merge(F.col("x"), F.col("y"), fraction)).collect():
            shingles = set()
            for w in (r.a.split(), r.b.split()):
                shingles |= {chained(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set()
            low = sorted(h for h in shingles if h <= bound)
            assert r.z == (low or sorted(shingles)[:1])


def test_short_texts_keep_enough_hashes(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(np.array([f"w{i}" for i in range(900)]), n)) for n in rng.integers(15, 60, 300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = lambda f: np.array([r.near_edited for r in fingerprints.compare_edited(rows, **f).orderBy("doc_id").collect()])
    got, true = near({}), near({"fraction": 1.0})
    assert not ((true >= 0.5) & (got == 0)).any() and np.abs(got - true).mean() < 0.1


@pytest.mark.parametrize("hot", [3, 1024])
def test_ids_of_many_rows_are_dealt_out(spark, monkeypatch, hot):
    monkeypatch.setattr(fingerprints, "HOT", hot)
    ids = [None] * 20 + [5] * 15 + [6] + [7] * 9 + list(range(100, 110)) + [700] * 12 + [10**12] * 2
    rows = [(d, f"text {i}") for i, d in enumerate(ids)] + [(7, "text 40")] * 5
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - 2**64 * (h >= 2**63)
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], signed(r[1]), r[1]))
    expected = Counter((*r, n[1]) for r, n in zip(ordered, [*ordered[1:], ordered[0]], strict=True))
    frame = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = fingerprints.with_next(frame)
    assert Counter((r.doc_id, r.text, r.next_text) for r in got.collect()) == expected
    if hot == 3:
        buckets = fingerprints._placed(frame.withColumn("hash", F.xxhash64("text"))).groupBy(*fingerprints.BUCKET).count()
        assert buckets.agg(F.max("count")).first()[0] <= 12 and buckets.count() > 10


def test_fingerprints_of_nothing_and_sparse_ids(spark, empty):
    assert fingerprints.compare_edited(empty).count() == 0
    rows = spark.createDataFrame([(i * 10**7, f"text {i}") for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(fingerprints.fingerprint(rows)).collect()}
    assert got == {i * 10**7: f"text {(i + 1) % 20}" for i in range(20)}


@pytest.mark.parametrize("groups", [2, 7, 4096])
def test_ids_far_apart_are_ordered_in_levels(spark, monkeypatch, groups):
    monkeypatch.setattr(fingerprints, "GROUPS", groups)
    ids = sorted([*[i << 40 for i in range(-60, 60)], *range(5), -(2**63), 2**63 - 1])
    ids = [None, *sorted(set(ids))]
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(fingerprints.fingerprint(rows)).collect()}
    assert got == {i: f"text {ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


# ---- simhash ----


def brute_simhash(text):
    w = words(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_components_match_brute_force(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, brute_simhash(r.text)) for r in docs.collect()]
    reach = {f: f for _, f in rows}

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for a, b in itertools.combinations(sorted(reach), 2):
        if (a ^ b).bit_count() <= 3:
            reach[root(b)] = root(a)
    least = defaultdict(list)
    for d, f in rows:
        if d is not None:
            least[root(f)].append(d)
    expected = Counter((d, f, min(least[root(f)], default=None)) for d, f in rows)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == expected
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert len(kept) == len({root(f) for _, f in rows}) and kept.count(None) == 1


def test_one_of_each_group_is_kept_when_ids_repeat(spark):
    rows = [(3, "a a a a", None), (5, "a a a a", "x"), (5, "b b b b", "y"), (7, "c c c c", "z"), (7, "c c c c", "z"), (7, "c c c c", None),
            (None, "d d d d", "p"), (None, "d d d d", "q"), (None, "e e e e", None), (9, "e e e e", "last")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 4):
        got = simhash.keep_first(frame.repartition(parts)).collect()
        assert sorted((r.text[0], r.doc_id) for r in got if r.doc_id) == [("a", 3), ("b", 5), ("c", 7), ("e", 9)]
        assert [r.text[0] for r in got if r.doc_id is None] == ["d"] and len(got) == 5
    assert {tuple(r) for r in got} == {tuple(r) for r in simhash.keep_first(frame.repartition(3)).collect()}


def test_long_chains_of_links_are_one_component(spark):
    n = 300
    links = spark.createDataFrame([((i * 7919) % 10007, ((i + 1) * 7919) % 10007) for i in range(n)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert set(got.values()) == {0} and len(got) == n


def test_dense_shards_in_slices(spark):
    rng = np.random.default_rng(0)
    base = int(rng.integers(2**63))
    values = sorted({base ^ sum(1 << int(b) for b in rng.integers(0, 30, 4)) for _ in range(400)} | {int(x) for x in rng.integers(0, 2**63, 200)})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.links(frame, tree=64, blocks=4).collect()
    from pricewright.llm.components import components

    got = {r.node: r.component for r in components(spark.createDataFrame(links)).collect()}
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 3:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {v: got.get(v, v) for v in values} == {v: root(v) for v in values}
    assert len(links) < 8 * len(values)


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_blocks_meet_every_pair(blocks):
    masks = simhash.block_masks(blocks)
    for bits in itertools.combinations(range(0, 64, 7), 3):
        apart = sum(1 << b for b in bits)
        assert any(m & apart == 0 for m in masks)
    assert [simhash.blocks_for(n) for n in (10, 10**6, 10**8, 10**12)] == sorted(simhash.blocks_for(n) for n in (10, 10**6, 10**8, 10**12))


# ---- personal data ----

BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_spans(text):
    out = []
    for kind, rule in enumerate(BASE):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and doubled % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_patterns():
    rng = np.random.default_rng(2)
    alphabet = np.array(list("ab1290.@+-() %_É\n") + ["4539148803436467", "10.0.0.1", "a@b.c", "+1 (017) 555-7713"])
    texts = ["".join(rng.choice(alphabet, 40)) for _ in range(3000)] + [t or "" for t in TEXTS]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t
    assert len(pii.base_spans("7" * 20000 + "@" + ".9" * 20000)) == 5000


def test_find_keeps_base_spans_and_rows(docs, empty):
    got = pii.find(docs).collect()
    expected = Counter((r.doc_id, pii.span_text(brute_spans(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.spans) for r in got) == expected
    assert all(hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256 for r in got if not r.n_added)
    assert pii.find(empty).count() == 0
    assert pii.redact(empty).count() == 0


def test_patterns_discover_what_the_base_rules_miss(spark):
    rows = [(i, f"number {i} please: Call: +1 (0{i:02d}) 555-77{i:02d} soon") for i in range(40)]
    rows += [(100, "please: Call: 017 555 7713 soon"), (101, "we had 017 555 7713 of them")]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100].spans == "phone:14:26" and found[100].n_phone == 0
    assert found[101].spans == ""
    text = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert text[100] == "please: Call: [PHONE] soon" and text[0] == "number 0 please: Call: [PHONE] soon" and text[101] == rows[-1][1]


def test_patterns_beyond_a_block_are_counted(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK" if hasattr(pii, "BLOCK") else "PATTERNS", 2)
    rows = [(i, f"hot: Call: +1 (0{i:02d}) 555-77{i:02d} soon") for i in range(40)]
    rows += [(50 + i, f"rare: Ring: +1 (0{i:02d}) 555-88{i:02d} soon") for i in range(30)]
    rows += [(100, "hot: Call: 017 555 7713 soon"), (101, "rare: Ring: 018 555 8813 soon")]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == "phone:11:23" and found[101] == "phone:12:24"


def test_trusted_candidates_admit_their_patterns(spark):
    # "Mail:" announces 200 addresses and 20 written with "(at)"; "hops over" announces only the latter, and a new one
    rows = [(i, f"send Mail: u{i}@x.org now") for i in range(200)]
    rows += [(300 + i, f"send Mail: v{i}(at)y.org now, hops over v{i}(at)y.org too") for i in range(20)]
    rows += [(400, "it hops over wanda(at)z.org too"), (401, "lost wilma(at)z.org again")]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[400].spans == "email:13:27" and found[401].spans == ""
    assert all(found[300 + i].n_added == 2 for i in range(20))


def test_patterns_are_counted_where_they_are_found():
    text = "Write mailto:bob@x.org or <a@b.de> , ip=10.0.0.1 mailto: x <p> ip ip=2"
    found = Counter(p for _, a, b in pii.base_spans(text) for p in pii.patterns(text, a, b))
    assert found == Counter([
        "<mailto:", "<write mailto:", "> or", "> or <a@b.de>", "=mailto:| or", "<<", "<or <", ">>", ">> ,", "=<|>",
        "<ip=", "<, ip=", "> mailto:", "> mailto: x", "=ip=| mailto:",
    ])
    assert pii.count_patterns(text, pii.Wanted([*found, "<mailto: ", "<ip "])) == {
        "<mailto:": 1, "<write mailto:": 1, "> or": 1, "> or <a@b.de>": 1, "=mailto:| or": 1, "<<": 2, "<or <": 1, ">>": 2, ">> ,": 1,
        "=<|>": 2, "<ip=": 2, "<, ip=": 1, "> mailto:": 1, "> mailto: x": 1, "=ip=| mailto:": 1, "<mailto: ": 1, "<ip ": 1,
    }


def test_patterns_see_whole_words():
    long, longer = "w" * 256, "v" * 5000
    text = f"{long} {long} a@b.de {longer} next"
    (_, a, b), = pii.base_spans(text)
    assert pii.patterns(text, a, b) == [f"<{long} ", f"<{long} {long} ", f"> {pii.LONG_WORD}", f"={long} | {pii.LONG_WORD}"]
    text = f"{longer}:a@b.de"
    assert pii.patterns(text, *pii.base_spans(text)[0][1:]) == [f"<{pii.LONG_WORD}"]
    many = ",".join(["a@b.de"] * 3000)
    assert len(pii.base_spans(many)) == 3000 and pii.graded(many, pii.base_spans(many)) == ([], [])
    assert pii.loose_shapes("x" * 200_000 + "(at)y.org") == [(0, 0, 200_009)]


def test_words_after_and_frames_discover(spark):
    rows = [(i, f"w{i} u{i}@x.org wrote: v{i}") for i in range(30)] + [(100 + i, f"a{i} [10.0.0.{i}] b{i}") for i in range(30)]
    rows += [(200 + i, f"c{i} the 10.1.0.{i} of d{i}, e{i} of it, of and of the f{i} q{i}, the the the r{i}") for i in range(30)]
    rows += [(300, "then bob(at)x.org wrote: no"), (301, "at [2001:db8::1] up"), (302, "and the 2001:db8::2 of some"), (303, "the 2001:db8::3 it"), (304, "bob(at)x.org wrote")]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[300] == "email:5:17" and found[301] == "ip:4:15" and found[302] == "ip:8:19"
    assert found[303] == "" and found[304] == ""


def test_shapes_inside_base_matches_are_seeds(spark):
    rows = [(i, f"x{i} +1 (0{i:02d}) 555-77{i:02d} y{i}") for i in range(40)] + [(100, "so +1 (555) 555-0000 10.0.0.1 12 end"), (101, "so (555) 555-0001 end")]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100].n_phone == 0 and "phone:6:20" in found[100].spans.split(",") and found[101].spans == ""


def test_keys_are_found_where_they_are_announced(spark):
    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'a{i} token = "{digest(i)}" b{i}') for i in range(30)] + [(100, 'my token = "Ab3-defgh_1jklm2nop" z'), (101, f"commit {digest(7777)} and Ab3-defgh_1jklm2nop")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(frame).collect()}
    assert found[3].keys == "key:12:52" and found[3].n_key == 1 and found[3].spans == ""
    assert found[100].keys == "key:12:31" and found[101].keys == "" and found[101].n_found == 0
    assert {r.doc_id: r.text for r in pii.redact(frame).collect()}[100] == 'my token = "[KEY]" z'


def test_precision_and_recall_of_added_spans(spark):
    """A generated corpus in which contexts announce identifiers, and decoys of the same forms stand in prose."""
    rng = np.random.default_rng(12)
    prose = lambda n: " ".join(rng.choice(WORDS, n))
    announce = {"email": ("contact:", "Mail to", "<"), "ip": ("host=", "from address"), "phone": ("call", "Tel."), "card": ("card no.",)}
    base = {"email": lambda i: f"u{i}@x{i % 7}.org", "ip": lambda i: f"10.{i % 200}.3.{i % 90}", "phone": lambda i: f"+1 (2{i % 90:02d}) 555-{i:04d}"}
    loose = {"email": lambda i: f"u{i}(at)y.org", "ip": lambda i: f"2001:db8::{i % 999}", "phone": lambda i: f"3{i % 90:02d} 555 {i:04d}"}
    rows, truth = [], set()
    for i in range(900):
        kind = ["email", "ip", "phone"][i % 3]
        label, parts = announce[kind][int(rng.integers(len(announce[kind])))], [prose(rng.integers(3, 15))]
        label += "" if label[-1] in "<=" else " "
        hidden, decoy = rng.random() < 0.3, rng.random() < 0.2
        value = (loose if hidden else base)[kind](i)
        start = len(parts[0]) + 1 + len(label)
        text = f"{parts[0]} {label}{value} {prose(5)}"
        if hidden:
            truth.add((i, f"{kind}:{start}:{start + len(value)}"))
        if decoy:
            text += f" {loose[kind](5000 + i)} {prose(4)}"
        rows.append((i, text))
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text_of_row = dict(rows)
    added = {(r.doc_id, s) for r in got for s in r.spans.split(",") if s} - {
        (d, s) for d, t in rows for s in pii.span_text(brute_spans(t)).split(",") if s
    }
    hits = len(added & truth)
    assert len(truth) > 200 and text_of_row
    assert hits / len(added) >= 0.98 and hits / len(truth) >= 0.95


def test_glued_labels_announce_identifiers(spark):
    rows = [(i, f"see mailto:u{i}@x.org now") for i in range(40)] + [(100 + i, f"host ip=10.0.0.{i} up") for i in range(40)]
    rows += [(200, "or mailto:bob(at)x.org now"), (201, "at ip=2001:db8::1 up"), (202, "lost bob(at)x.org and 2001:db8::1 here")]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[200] == "email:10:22" and found[201] == "ip:6:17" and found[202] == ""


def test_redaction_merges_overlaps():
    assert pii.redact_text("ab 12 cd", [(0, 3, 5), (2, 3, 8)]) == "ab [CARD]"
    assert pii.redact_text("", []) == ""


# ---- language model ----


def discounts(counts):
    """Good-Turing ratios for counts 1 to 5, from a least-squares line through the smoothed counts of counts up to 64."""
    n = {r: k for r, k in Counter(counts).items() if r <= 64}
    rs = sorted(n)
    b = -2.0
    if len(rs) > 1:
        xs, ys = [], []
        for i, r in enumerate(rs):
            q = rs[i - 1] if i else 0
            t = rs[i + 1] if i + 1 < len(rs) else 2 * r - q
            xs.append(math.log(r))
            ys.append(math.log(2 * n[r] / (t - q)))
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        b = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
        b = min(b, -1.05)
    line = lambda r: float(r) ** b
    cut = 6 * line(6) / line(1)
    return {r: ((r + 1) * line(r + 1) / (r * line(r)) - cut) / (1 - cut) for r in range(1, 6)}


def brute_katz(rows):
    """Scores by explicit dictionaries over (doc_id, text), and sums of probabilities after some contexts."""
    tokens = [[*words(lower(t)), "</s>"] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    uni, bi, tri, context = Counter(), Counter(), Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            uni.update(t)
            marked = ["<s>", *t]
            bi.update(zip(marked, t))  # noqa: B905
            tri.update(zip(marked, marked[1:], marked[2:]))  # noqa: B905
    for gram in (bi, tri):
        for g, c in gram.items():
            context[g[:-1]] += c
    n, v = sum(uni.values()), len(uni)
    ratio = [discounts(c.values()) for c in (uni, bi, tri)]
    d = lambda c, k: c * ratio[k].get(c, 1.0)
    more = lambda c: c + 1 if c > 5 else c
    left = more(n) - sum(d(c, 0) for c in uni.values())
    p1 = lambda w: (d(uni[w], 0) if w in uni else left) / more(n)
    follow = defaultdict(list)
    for g in [*bi, *tri]:
        follow[g[:-1]].append(g[-1])

    def p(ctx, w):
        if not ctx:
            return p1(w)
        if ctx not in context:
            return p(ctx[1:], w)
        seen = lambda x: d((bi, tri)[len(ctx) - 1][(*ctx, x)], len(ctx)) / more(context[ctx])
        if w in follow[ctx]:
            return seen(w)
        if ctx not in weight:
            lower_mass = sum(p(ctx[1:], x) for x in follow[ctx])
            weight[ctx] = (1 - sum(map(seen, follow[ctx]))) / (1 - lower_mass)
        return weight[ctx] * p(ctx[1:], w)

    weight: dict = {}
    out = []
    for (doc_id, _), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for i, w in enumerate(t):
            score += math.log10(p(tuple(["<s>", *t][max(0, i - 1) : i + 1]), w))
        out.append((doc_id, h, len(t), sum(w in uni for w in t), n, round(base, 6), round(score, 6)))
    sums = [sum(p(a, w) for w in uni) + p(a, "unknown word") for a in [(), *list(context)[:30], *list(context)[-30:]]]
    return out, sums


@pytest.mark.parametrize("direct", [1, 2048])
def test_katz_matches_brute_force_and_sums_to_one(docs, empty, direct):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected, sums = brute_katz(rows)
    assert np.allclose(sums, 1)
    got = katz.scores(docs, chunk_tokens=300, bucket_tokens=200, direct=direct).collect()
    assert Counter((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == Counter(expected)
    assert katz.scores(empty).count() == 0


def test_katz_backs_off_in_texts_with_irregular_counts(spark):
    rng = np.random.default_rng(8)
    vocabulary = np.array([f"w{i}" for i in range(120)])
    weights = 1 / np.arange(1, 121) ** 1.1
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 90), p=weights / weights.sum()))) for i in range(120)]
    expected, sums = brute_katz(rows)
    assert np.allclose(sums, 1)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for direct in (2, 2048):
        got = katz.scores(frame, chunk_tokens=700, bucket_tokens=300, direct=direct).collect()
        assert Counter((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == Counter(expected)
        held = [r for r in got if r.held_out]
        assert any(r.n_seen_triples < r.n_seen_pairs < r.n_tokens for r in held)


def test_katz_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    frame = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    assert [(r.score, r.n_known, r.train_tokens) for r in katz.scores(frame).collect()] == [(0.0, 0, 0)] * 3


@pytest.mark.parametrize(
    "counts",
    [[1] * 50 + [2] * 20 + [3] * 9 + [4] * 10 + [5] * 11 + [6] * 4 + [40], [1] * 3 + [2] * 30, [1] * 9, [], [7, 9, 70], [1, 2, 3, 4, 5, 6, 7, 8]],
)
def test_discounts_are_good_turings(counts):
    spectrum = [counts.count(r) for r in range(1, katz.FITTED + 1)]
    got, expected = katz.good_turing(spectrum), discounts(counts)
    assert got == pytest.approx([expected[r] for r in range(1, 6)])
    assert all(0 < x < 1 for x in got) and list(got) == sorted(got)


def test_ranges_send_no_more_runs_than_keys():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 2**64, 40, dtype=np.uint64))
    for per_bucket, direct in ((1, 10**9), (7, 5), (1000, 1)):
        ranges = katz.Ranges.over(100_000, 1000, per_bucket, direct)
        runs = ranges.sent(keys)
        assert len(runs) <= min(len(keys), -(-ranges.buckets // ranges.per)) and sum(b - a for _, a, b in runs) == 40


def test_packing_round_trips():
    for values in (np.array([], np.uint64), np.array([0, 2**63, 5], np.uint64), np.arange(70000, dtype=np.int32)):
        assert (katz.unpack(katz.pack(values), values.dtype.type) == values).all()
    for values in (np.array([], np.uint64), np.array([3, 9, 2**64 - 1, 0, 5], np.uint64)):
        assert (katz.unpack_sorted(katz.pack_sorted(values)) == values).all()


# ---- quality ----


def test_quality_learns_held_out_labels(spark):
    rng = np.random.default_rng(1)
    good = [(i, " ".join(rng.choice(WORDS, 80)) + ".") for i in range(0, 600, 2)]
    bad = [(i, "!!! ".join(w.upper() for w in rng.choice(WORDS, 80))) for i in range(1, 600, 2)]
    docs = spark.createDataFrame([*good, *bad, (9999, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(600)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in held) / len(held) > 0.95
    assert quality.train(docs, labels.where("quality = 1")).constant == 1.0
    assert quality.train(docs, labels.where("false")).constant == 0.5


# ---- mixing ----


def test_stages_keep_clashing_columns(docs):
    """Columns that share a name with something that an operator adds keep their values."""
    model = quality.Model(b"", b"", constant=1.0)
    for out in (quality.accepted(docs, model), pii.redact(docs), mixing.mix(docs), simhash.keep_first(docs)):
        assert out.columns == docs.columns
        assert {(r.sketch, r.score, r["rank"], r.fp, r.key) for r in out.collect()} == {("clash", 0.5, 7, 9, "k")}


def test_mix_keeps_targets_and_repeats(spark, docs, empty):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), None if i % 9 == 8 else f"s{i % 9 % 4}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = mixing.sized(frame)
    plan = mixing.plan(sizes)
    got = mixing.with_copies(sizes, plan).collect()
    taken, target, size = Counter(), {}, {}
    for r in got:
        taken[r.source] += r.copies * r["size"]
        target[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r.copies <= 2
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_mix_splits_equal_rows_and_null_ids(spark):
    rows = [(None, "b " * 10, "b") for _ in range(2000)] + [(None, f"a{i} " * 10, "a") for i in range(1000)] + [(5, "c", "c")] * 7
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    goal = {r.source: r.target for r in mixing.source_targets(mixing.sized(frame)).collect()}
    got = Counter()
    for r in mixing.mix(frame).collect():
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - goal[s]) <= 10 for s in goal) and goal["b"] % 10 and goal["b"] < 40000
    again = Counter()
    for r in mixing.mix(frame.repartition(3)).collect():
        again[r.source, r.text] += 1
    assert again == Counter((r.source, r.text) for r in mixing.mix(frame).collect())


def test_inclusion_follows_the_probabilities(spark):
    rng = np.random.default_rng(6)
    lengths = rng.choice([20, 300, 2500], 12000, p=[0.6, 0.3, 0.1])
    frame = spark.createDataFrame([(i, int(n), "s", str(i)) for i, n in enumerate(lengths)], "doc_id long, size long, source string, text_key string")
    rows = mixing.with_copies(frame, mixing.plan(frame, share=0.4)).collect()
    q = lengths / (lengths + mixing.HALF)
    p = 0.4 + 0.4 * (q - (q * lengths).sum() / lengths.sum())
    taken = {r.doc_id: r.copies for r in rows}
    for n in (20, 300, 2500):
        own = np.flatnonzero(lengths == n)
        share = np.mean([taken[i] for i in own])
        assert abs(share - p[own[0]]) < 4.5 * math.sqrt(0.25 / len(own))
    assert abs(sum(taken[i] * n for i, n in enumerate(lengths.tolist())) - 0.4 * lengths.sum()) <= 2500


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 1, "b": 500, "c": 100, None: 40}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    total, capped, expected = 1.5 * sum(sizes.values()), {}, {}
    while True:
        left = {s: weight[s] for s in sizes if s not in capped}
        expected = {s: (total - sum(capped.values())) * w / sum(left.values()) for s, w in left.items()}
        over = {s: 2.0 * sizes[s] for s in left if expected[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(capped | expected)


# ---- pieces ----


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load()


def test_pre_tokens_join_to_the_text():
    for t in TEXTS:
        assert "".join(pieces.pre_tokens(t or "")) == (" " + t if t else "")


def test_token_counts_match_the_library(spark, docs, empty, vocabulary):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type in (1, 4):
            p.score, p.type = vocabulary.scores[p.piece.replace("▁", " ")], 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    expected = Counter((r.doc_id, len(library.encode(r.text or ""))) for r in docs.collect() if "▁" not in (r.text or ""))
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, nodes=50).collect() if r.doc_id != 11)
    assert got == expected
    assert token_counts.token_counts(empty).count() == 0


def toy():
    names = ["a", "b", "ab", "ba", "aa", " ", " a", "aba"]
    return pieces.Pieces.ranked([(t, 300 + i) for i, t in enumerate(names)], list(range(256)))


def paths(text, known):
    if not text:
        return [()]
    return [(text[:k], *rest) for k in range(1, len(text) + 1) if text[:k] in known for rest in paths(text[k:], known)]


@pytest.mark.parametrize("depth", [1, 24])
def test_samples_follow_the_lattice(depth, monkeypatch):
    monkeypatch.setattr(segmentations, "DEPTH", depth)
    known, n, k, text = toy(), 6000, 3, "abab"
    found = paths(" " + text, known.scores)
    p = np.array([math.exp(sum(known.scores[x] for x in q)) for q in found])
    p /= p.sum()
    key = {tuple(known.ids[x] for x in q): j for j, q in enumerate(found)}
    block = segmentations.encode_block(segmentations.Store(segmentations.Walker(known, 4), 1.0), segmentations.Codec(known), list(range(n)), [text] * n, k, "array")
    rows = block.to_pylist()
    drawn = np.full((n, k), -1)
    weight = np.zeros(n)
    for r in rows:
        j = key[tuple(r["ids"])]
        drawn[r["doc_id"], r["sample"]] = j
        assert r["log_prob"] == pytest.approx(math.log(p[j])) and r["round_trip"]
        weight[r["doc_id"]] += math.exp(r["log_prob"] - r["inclusion"])
    assert all(len(set(row)) == k for row in drawn)
    second = [sum(p[a] * p[b] / (1 - p[a]) for a in range(len(p)) if a != b) for b in range(len(p))]
    for column, expected in ((0, p), (1, second)):
        share = np.bincount(drawn[:, column], minlength=len(p)) / n
        assert np.abs(share - expected).max() < 4.5 * math.sqrt(0.25 / n)
    assert abs(weight.mean() - 1) < 5 * weight.std() / math.sqrt(n)


def test_few_segmentations_come_once(spark):
    known = toy()
    block = segmentations.encode_block(segmentations.Store(segmentations.Walker(known, 4), 1.0), segmentations.Codec(known), [1, 2, 3], ["b", "", "é"], 4, "array")
    rows = block.to_pylist()
    assert [(r["doc_id"], r["sample"], r["inclusion"]) for r in rows] == [(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)]
    assert rows[2]["ids"] == [305, *"é".encode()]


def test_encoding_round_trips_and_repeats(docs, empty):
    rows = segmentations.encoded(docs, ids="array")
    back = segmentations.decoded(rows).collect()
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text or "")
    assert all(r.decoded in texts[r.doc_id] and r.round_trip for r in back)
    packed = segmentations.decoded(segmentations.encoded(docs.repartition(5), ids="packed")).collect()
    assert Counter((r.doc_id, r.sample, r.n_pieces, r.decoded) for r in packed) == Counter((r.doc_id, r.sample, r.n_pieces, r.decoded) for r in back)
    assert segmentations.encoded(empty).count() == 0


def test_the_query_returns_the_segmentations(spark, tmp_path):
    import xxhash

    texts = ["a plain text of words", "ünï\n\nwords  and more words", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = segmentations.op2_gumbel_pieces(spark, str(tmp_path))
    got = segmentations.decoded(rows).collect()
    assert {r.doc_id for r in got if r.sample == 1} == {0, 1} and len(got) == 6
    for r in got:
        words = segmentations.unpacked(bytes(r.ids)).astype("<i4")
        assert r.decoded == (texts[r.doc_id] or "") and len(words) == r.n_pieces
        assert xxhash.xxh3_128_hexdigest(words.tobytes()) == r.ids_hash


# ---- chat ----


def test_layouts_meet_in_the_same_turns(spark):
    records = [
        '{"messages":[{"role":"user","content":"q <|im_end|>\\n \\\\"},{"role":"assistant","content":"a</s>"}]}',
        '{"conversations":[{"from":"human","value":"q <|im_end|>\\n \\\\"},{"from":"gpt","value":"a</s>"}]}',
        '{"prompt":"q <|im_end|>\\n \\\\","completion":"a</s>"}',
        '{"output":"a</s>","instruction":"q <|im_end|>\\n \\\\"}',
        '{"question":"q <|im_end|>\\n \\\\","answer":"a</s>"}',
        '{"other":1}', None, "not json", '{"messages":[]}',
    ]
    frame = spark.createDataFrame(list(enumerate(records)), "i int, record string")
    rows = chat.read_back(chat.formatted(chat.canonical(frame))).orderBy("i").collect()
    for r in rows[:5]:
        assert [tuple(t) for t in r.read_turns] == [("user", "q <|im_end|>\n \\"), ("assistant", "a</s>")]
        assert r.loss_text == "a</s>" and r.formatted.count(chat.END) == 2 and "</s>" not in r.formatted
    assert rows[5].turns is None and rows[6].turns is None and rows[7].turns is None and rows[8].turns == []


def test_shapes_tell_layouts_apart(spark):
    records = [
        '{"data":{"prompt":"q"}}', '{"data":{"foo":"q"}}', '{"data":"x"}', '{"data":[{"prompt":"q"}]}', '{"data":[{"x":1},{"prompt":"q"}]}',
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","text":"a"}]}',
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a","name":"n"}]}',
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a","tool":{"k":"v"}}]}',
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a","tool":{"j":"v"}}]}',
        '{"messages":[{"role":"user","content":["q"]}]}', '{"messages":[{"role":"user","content":"q","content":"r"}]}',
    ]
    known = [
        '{"messages":[{"content":"q","role":"user"},{"role":"assistant","content":null}]}', '{"messages":[{"role":"user","content":7}]}',
        '{"conversation":{"messages":[{"speaker":"user","text":"q"}]}}', '{"data":{"response":"a","prompt":"q"}}',
    ]
    frame = spark.createDataFrame(list(enumerate(records + known)), "i int, record string")
    rows = chat.canonical(frame).orderBy("i").collect()
    prints = [r.fingerprint for r in rows[: len(records)]]
    assert prints[-1] is None and len(set(prints)) == len(prints) and all(r.turns is None for r in rows[: len(records)])
    assert [[tuple(t) for t in r.turns] for r in rows[len(records) :]] == [
        [("user", "q"), ("assistant", "")], [("user", "7")], [("user", "q")], [("user", "q"), ("assistant", "a")],
    ]


def test_mixed_layouts_say_the_same(spark):
    rng = np.random.default_rng(5)
    roles = [["user", "assistant"], ["system", "user", "assistant"], ["user"], ["human", "gpt", "user"], ["user", "assistant", "user", "assistant"], [None, "tool"]]
    rows = []
    for i in range(60):
        for turn, role in enumerate(roles[i // 3 % 6]):
            rows.append((i - 7 if i else None, turn, role, [None, "", "a\nb", 'x "q" \\ </s>', "é 日本"][rng.integers(5)], "clash", "clash"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string, fingerprint string")
    mixed = chat.canonical(chat.mixed_records(frame)).collect()
    plain = {r.conv_id: r.turns for r in chat.canonical(chat.records_from_rows(frame)).collect()}
    assert {r.conv_id: r.turns for r in mixed} == plain and len({r.fingerprint for r in mixed}) == 6
    empty = frame.where("false")
    assert chat.read_back(chat.formatted(chat.canonical(chat.mixed_records(empty)))).count() == 0


def test_rows_become_turns_in_order(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, None, None, "x"), (None, 0, "user", "n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.canonical(chat.records_from_rows(frame)))).collect()}
    assert [tuple(t) for t in got[1].read_turns] == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert got[1].loss_text == "bb" and [tuple(t) for t in got[2].read_turns] == [("", "x")] and None in got


# ---- edges ----


def test_every_operator_on_an_empty_table(spark, empty):
    from pricewright.llm import neighbours

    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(empty, labels)
    assert model.constant == 0.5 and quality.scored(empty, model).count() == 0 and quality.accepted(empty, model).columns == empty.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).columns == empty.columns
    assert katz.scores(empty).count() == 0 and mixing.mix(empty).columns == empty.columns
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.search(vectors, F.col("vec_id") % 20 == 0).count() == 0


def test_very_long_texts(spark):
    """A text of a million characters without a blank, one of 150 000 words, and one line of one repeated shingle."""
    rng = np.random.default_rng(1)
    texts = ["x" * 1_000_000, " ".join(f"w{i}" for i in rng.integers(0, 5000, 150_000)), "a b " * 40_000, None, ""]
    rows = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    fps = {r.doc_id: r.fp for r in simhash.fingerprints(rows).collect()}
    assert fps[3] == fps[4] == 0 and fps[2] % 2**64 == brute_simhash(texts[2])
    sizes = {r.doc_id: r["size"] for r in mixing.sized(rows).collect()}
    assert sizes == {0: 1, 1: 150_000, 2: 80_000, 3: 0, 4: 0}
    counts = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(rows).collect()}
    assert counts[0][0] == 1 and counts[0][1] > 10_000 and counts[1][0] == 150_000 and counts[3] == counts[4] == (0, 0)
    pieces_of = segmentations.encoded(rows, samples=1, ids="hash").collect()
    assert len(pieces_of) == 5 and all(r.round_trip for r in pieces_of)
    found = {r.doc_id: r for r in pii.find(rows).collect()}
    assert len(found) == 5 and all(r.n_found == 0 for r in found.values())
    got = {r.doc_id: r for r in katz.scores(rows).collect()}
    assert got[1].n_tokens == 150_001 and got[3].n_tokens == 1 and all(math.isfinite(r.score) for r in got.values())


def test_quality_measures_sizes_as_stated(spark):
    """The evidence of a handful of texts, and a score, worked out step by step."""
    import zstandard

    good, bad = b"the good text of the house " * 20, b"zz qq xx buy now $$$ " * 20
    texts = [b"", b"the good text", b"buy now $$$ zz", "\u00e9t\u00e9".encode() * 9]
    sizes = lambda d: [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d) if d else None).compress(t)) for t in texts]
    g, b, plain = sizes(good), sizes(bad), sizes(None)
    n = [max(len(t), 1) for t in texts]
    expected = [((y - x) / k, (y - x) / p, p / k, math.log(k)) for x, y, p, k in zip(g, b, plain, n, strict=True)]
    got = quality.evidence(good, bad)(texts)
    assert np.allclose(got, expected)
    model = quality.Model(good, bad, (0.1,) * 9, (2.0,) * 9, tuple(0.3 * k for k in range(10)))
    for row, score in zip(expected, model.scorer()(texts), strict=True):
        terms = [*row, *(v * v for v in row), row[0] * row[3]]
        z = sum(0.3 * k * (t - 0.1) / 2.0 for k, t in enumerate(terms)) + 0.3 * 9
        assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_quality_fit_of_repeated_ids_and_long_texts(spark):
    rng = np.random.default_rng(3)
    made = lambda words, n: " ".join(rng.choice(np.array(words.split()), n))
    rows, labels = [], []
    for i in range(160):
        rows.append((i, made("calm river stone old bridge light", 40 if i % 40 else 30_000) if i % 2 else made("win cash now click free prize", 40)))
        labels.append((i, i % 2))
    rows += [(1, made("calm river stone", 12)) for _ in range(50)] + [(1, rows[1][1])] * 3
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), per_class=70)
    assert model.constant is None and max(len(model.good), len(model.bad)) <= quality.DICTIONARY
    good, bad = model.scorer()([b"old bridge over the calm river", b"click now and win a free prize"])
    assert good > 0.5 > bad


def test_tables_between_steps_need_a_shared_folder(spark, monkeypatch):
    from pricewright import session
    from pricewright.llm import scratch

    table = scratch.written(spark.range(3).toDF("x"), "probe")
    assert table.count() == 3 and table.written_to in scratch._PATHS
    scratch.discard(table, None, spark.range(1))
    assert table.written_to not in scratch._PATHS

    class Far:
        master = "spark://host:7077"
        getConf = lambda self: type("C", (), {"get": lambda self, k: None})()
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    far = type("Session", (), {"sparkContext": Far(), "conf": type("C", (), {"get": lambda self, k, d=None: None})()})()
    with pytest.raises(RuntimeError):
        session.shared_folder(far)
