"""Line dedup, quality rules, near-duplicates and personal data against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimcheck.llm import components, line_dedup, pii, quality, simhash
from tests.llm.conftest import DOCS, doc


def key(line):
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if c.isascii() else c for c in stripped)


def kept_lines(docs):
    least = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                least[key(line)] = min(i, least.get(key(line), i))
    return [
        (i, "\n".join(x for x in (text or "").split("\n") if i is None or len(key(x)) < 10 or least[key(x)] == i))
        for i, text in docs
    ]


def deduplicated(frame):
    return line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame))


def test_line_dedup_odd_rows(odd_docs):
    found = [(r["doc_id"], r["text"]) for r in deduplicated(odd_docs).collect()]
    assert sorted(found, key=repr) == sorted(kept_lines([(r[0], r[1]) for r in odd_docs.collect()]), key=repr)


def test_line_dedup_hot_line(spark):
    """One line in every document, over more partitions than keys."""
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(["The SAME line everywhere", f"line number {rng.randrange(300)}", "x"]) for _ in range(8))) for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = [(r["doc_id"], r["text"]) for r in deduplicated(frame).collect()]
    assert sorted(found) == sorted(kept_lines(docs))


def test_bitmaps(spark):
    frame = spark.createDataFrame([(1, "a line of some length\nb"), (2, "c\nA line of some length\nd")], "doc_id long, text string")
    row = line_dedup.keep_bitmaps(frame).first()
    assert (row["doc_id"], row["n_lines"], row["n_dropped"]) == (2, 3, 1)
    assert np.unpackbits(np.frombuffer(zlib.decompress(row["keep"]), np.uint8), count=3).tolist() == [1, 0, 1]


def test_line_dedup_of_nothing(no_docs):
    assert deduplicated(no_docs).count() == 0 and deduplicated(no_docs).columns[-2:] == ["n_lines", "n_dropped"][-2:]


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))


@pytest.mark.parametrize("seed", range(6))
def test_features(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b", "c ", " ", "\n", " ", "#", "| ", "é", "\x0b", "\x1c"]) for _ in range(400))
    assert quality.features(text) == plain_features(text)
    assert quality.features("") == (0, 0, 0, 0, 0)


def test_quality_rejects_junk_and_odd_rows(spark, odd_docs, no_docs):
    found = {(r["doc_id"], r["n_words"]): r for r in quality.judge(odd_docs).collect()}
    assert found[1, 0]["base_failed"] and found[2, 0]["base_failed"] and found[3, 60_000]["base_failed"]
    assert quality.judge(no_docs).count() == 0
    rng = random.Random(1)
    clean = [doc(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), "en", rng.choice("ab")) for i in range(500)]
    junk = [doc(i, " ".join(f"w{rng.randrange(10**6)}***" for _ in range(60)), "en", "a") for i in range(500, 560)]
    judged = quality.judge(spark.createDataFrame(clean + junk, DOCS))
    assert {r["doc_id"] for r in judged.where("kept").collect()} == {d[0] for d in clean}


def test_sketches_merge_and_bound_their_error(spark):
    values = [int(random.Random(i).paretovariate(0.4)) for i in range(3000)]
    b = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).cast("long").alias("b"))
    for r in b.withColumn("low", quality.bucket_floor(F.col("b"))).collect():
        assert r["low"] <= r["v"] < r["low"] + max(1, r["low"] / 16 + 1)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {i: i for i, _ in fps}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in fps}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(80)] for _ in range(25)]
    docs = [(0, None), (1, ""), (2, "one"), (3, "One  TWO")]
    for i in range(4, 220):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(80)] = f"v{rng.randrange(9)}"
        docs.append((i, " ".join(words)))
    found = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in docs]
    assert {r["doc_id"]: r["fp"] % 2**64 for r in found} == dict(fps)
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_components(fps)
    links = {i: sum((a ^ b).bit_count() <= 2 for _, b in fps) - 1 for i, a in fps}
    assert {r["doc_id"]: r["n_links"] for r in found} == links


def test_links_equal_brute_force(spark):
    rng = random.Random(9)
    fps = {0, -1, 1, 1 << 62, -(1 << 63)}
    for _ in range(60):
        f = rng.getrandbits(64)
        for flips in ([], [3], [3, 9], [62, 63], [40], [0, 1, 2]):
            g = f
            for bit in flips:
                g ^= 1 << bit
            fps.add(g - (1 << 64) if g >> 63 else g)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = [(r["a"], r["b"]) for r in simhash.linked(frame).collect()]
    wanted = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    assert len(found) == len(set(found)) and set(found) == wanted


def test_simhash_odd_rows(odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count() and {r["component_id"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert [r["n_links"] for r in found if r["doc_id"] == 8] == [2]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (500, 300)]
    random.Random(2).shuffle(chain)
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    wanted = defaultdict(int, {i: 0 for i in range(41)}) | {i: 100 for i in range(100, 130)} | {300: 300, 500: 300}
    assert found == wanted


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            sums = [int(d) if i % 2 == 0 else sum(divmod(int(d) * 2, 10)) for i, d in enumerate(reversed(digits))]
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(sums) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[2]), s[1]))


@pytest.mark.parametrize("seed", range(40))
def test_base_detectors(seed):
    rng = random.Random(seed)
    parts = ["a", "b.c", "@", "1", "22", "255", ".", "-", " ", "+", "(", ")", "é", "4111111111111111", "x@y.z", "10.0.0.1", "+1 (555) 123-4567"]
    text = "".join(rng.choice(parts) for _ in range(60))
    assert pii.detect(text) == plain_pii(text)


def test_base_detectors_stay_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, " " * 200_000):
        pii.hidden(text, pii.detect(text))


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("mail jo.doe (at) example (dot) com now", "email", "jo.doe (at) example (dot) com"),
        ("mail jo at example dot com now", "email", "jo at example dot com"),
        ("mail jo[at]example[dot]com", "email", "jo[at]example[dot]com"),
        ("mail jo AT example.com!", "email", "jo AT example.com"),
        ("mail jоhn@example.com", "email", "jоhn@example.com"),
        ("mail ｊｏ＠ｅｘ．ｃｏｍ ok", "email", "ｊｏ＠ｅｘ．ｃｏｍ"),
        ("ip one nine two dot 168 dot zero dot one end", "ip", "one nine two dot 168 dot zero dot one"),
        ("ip 10.０.0.１ end", "ip", "10.０.0.１"),
        ("call +1 five five five one two three four five six seven ok", "phone", "+1 five five five one two three four five six seven"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
        ("card 4111​1111​1111​1111 x", "card", "4111​1111​1111​1111"),
        ("jо at exаmple dot com", "email", "jо at exаmple dot com"),
    ],
)
def test_disguises(text, kind, span):
    found = pii.hidden(text, pii.detect(text))
    assert (kind, span) in [(k, text[s:e]) for s, e, k in found]


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("mail jo@example[.]com now", "email", "jo@example[.]com"),
        ("mail jo@example(.)com now", "email", "jo@example(.)com"),
        ("ip 10[.]0[.]0[.]1 end", "ip", "10[.]0[.]0[.]1"),
        ("mail jo  at  example.com now", "email", "jo  at  example.com"),
        ("mail jo\tat\texample.com now", "email", "jo\tat\texample.com"),
        ("mail jo (  at  ) example.com now", "email", "jo (  at  ) example.com"),
        ("mail jo [\tat\t] example.com now", "email", "jo [\tat\t] example.com"),
        ("mail jo {  @  } example.com now", "email", "jo {  @  } example.com"),
        ("card 4111 1111 1111 111 one.", "card", "4111 1111 1111 111 one"),
        ("ip 192.168.zero.one end", "ip", "192.168.zero.one"),
        ("call +1 555 123 456 seven.", "phone", "+1 555 123 456 seven"),
        ("call +1 555 123 4 FİVE six seven.", "phone", "+1 555 123 4 FİVE six seven"),
    ],
)
def test_disguises_need_no_hints_elsewhere(text, kind, span):
    """One disguise is found whatever else the text holds, in every spelling that the rewriting knows."""
    for whole in (text, text + " More: one, two, three dots (at) four."):
        assert (kind, span) in [(k, whole[s:e]) for s, e, k in pii.hidden(whole, pii.detect(whole))]


@pytest.mark.parametrize("text", ["meet at noon. Then one or two at three", "polka dot dress at home", "Straße für 12 Äpfel, à 3·5 €", "look at it.\nAnd at e.g. this"])
def test_clean_text_is_left_alone(text):
    assert pii.hidden(text, pii.detect(text)) == []


def test_redaction(spark, odd_docs, no_docs):
    text = "é jo@ex.com and jo at ex dot org, +1 (555) 123-4567."
    frame = spark.createDataFrame([doc(1, text), doc(2, None)], DOCS)
    found = pii.redact(frame).orderBy("doc_id").collect()
    assert [r["text"] for r in found] == ["é <EMAIL> and <EMAIL>, <PHONE>.", None]
    assert pii.redact(no_docs).count() == 0
    same = pii.redact(odd_docs)
    assert same.columns == odd_docs.columns and sorted(map(tuple, same.collect()), key=repr) == sorted(map(tuple, odd_docs.collect()), key=repr)


def test_hash_of_kept_text_is_of_utf8(spark):
    frame = spark.createDataFrame([(1, "ü\nzwölf Zeichen lang")], "doc_id long, text string")
    row = deduplicated(frame).select(F.sha2("text", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256("ü\nzwölf Zeichen lang".encode()).hexdigest()


def test_pii_query_equals_plain_python(spark):
    from claimcheck.llm.queries import QUERIES
    from tests.conftest import TESTDATA

    folder = f"{TESTDATA}/sf0.001"
    found = {r["doc_id"]: r for r in QUERIES["op7_pii"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        base = [f"{k}:{s}:{e}" for s, e, k in plain_pii(d["text"] or "")]
        row = found[d["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert {k: row[f"n_{k}"] for k in PATTERNS} == {k: sum(b.startswith(k) for b in base) for k in PATTERNS}
        assert set(base) <= set(row["spans"].split(",") if row["spans"] else [])
