"""The pipeline, stage by stage, against plain Python over whole tables."""

import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from claimcheck.llm import near_copies
from tests.conftest import TESTDATA
from tests.llm.conftest import DOCS
from tests.llm.test_documents import kept_lines, plain_features, plain_pii

FOLDER = f"{TESTDATA}/sf0.001"
KINDS = ["email", "ip", "card", "phone"]


def low(v):
    shift = max(0, v.bit_length() - 5)
    return v >> shift << shift


def at(values, percent):
    return sorted(values)[-(-len(values) * percent // 100) - 1]


def plain_quality(docs):
    passed = {}
    for d in docs:
        words, chars, symbols, dup, repeated = plain_features(d["text"] or "")
        if words >= 10 and 100 * repeated <= 20 * words:
            passed[d["doc_id"]] = (d, [symbols * 1000 // max(chars, 1), dup * 1000 // words, chars * 10 // words])

    def quantile(k, percent, *groups):
        """Of the smallest group, blended with those around it."""
        own = [low(r[k]) for r in groups[0]]
        if len(groups) == 1:
            return at(own, percent)
        return (len(own) * at(own, percent) + 10 * quantile(k, percent, *groups[1:])) // (len(own) + 10)

    def accepted(d, rates):
        groups = [[r for x, r in passed.values() if x["lang"] == d["lang"] and x["source"] == d["source"]]]
        groups += [[r for x, r in passed.values() if x["lang"] == d["lang"]], [r for _, r in passed.values()]]
        for k, slack in enumerate((20, 30, 60)):
            q25, q50 = (quantile(k, p, *groups) for p in (25, 50))
            if rates[k] > q50 + 3 * (q50 - q25) + slack:
                return False
        return True

    return [d for d, rates in passed.values() if accepted(d, rates)]


def redacted(text):
    out, end = "", 0
    for start, stop, kind in sorted(plain_pii(text)):
        if start >= end:
            out += text[end:start] + f"<{kind.upper()}>"
        end = max(end, stop)
    return out + text[end:]


def test_stages_equal_plain_python(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "personal_data", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    rows = docs.collect()

    def step(name, frame):
        found = stages[name](spark, frame, FOLDER)
        assert found.columns == docs.columns
        return spark.createDataFrame(found.collect(), docs.schema).cache()

    judged = step("quality_rules", docs)
    assert {r["doc_id"] for r in judged.collect()} == {d["doc_id"] for d in plain_quality(rows)}
    lines = step("line_dedup", judged)
    wanted = dict(kept_lines([(r["doc_id"], r["text"]) for r in judged.collect()]))
    before = {r["doc_id"]: r["text"] for r in judged.collect()}
    wanted = {i: t for i, t in wanted.items() if t or t == before[i]}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    single = step("near_duplicates", lines)
    roots = plain_roots(list(wanted.items()))
    assert {r["doc_id"] for r in single.collect()} == {i for i, root in roots.items() if i == root}
    private = step("personal_data", single)
    assert {r["doc_id"]: r["text"] for r in private.collect()} == {r["doc_id"]: redacted(r["text"]) for r in single.collect()}
    packed = stages["packing"](spark, private, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in private.collect()}
    got = dict.fromkeys(sizes, 0)
    for r in packed:
        assert r["doc_tokens"] == sizes[r["doc_id"]]
        got[r["doc_id"]] += r["length"]
    assert got == sizes and sorted(r["sequence_id"] * 1024 + r["offset"] for r in packed)[0] == 0
    assert corpus_pipeline.run(spark, FOLDER).count() == len(packed)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd_docs, no_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, no_docs, FOLDER).count() == 0
    found = stage(spark, odd_docs, FOLDER)
    assert name == "packing" or found.columns == [f.split()[0] for f in DOCS.split(", ")]
    kept = {r["doc_id"] for r in found.collect()}
    everything = {1, 2, 3, 4, 5, None, 7, 8, 9}
    assert kept == {
        "quality_rules": set(),
        "line_dedup": everything,
        "near_duplicates": everything - {2, 8},
        "personal_data": everything,
        "packing": everything,
    }[name]


def test_quality_stage_judges_each_row_for_itself(spark):
    """Rows that share a doc_id, or have none, go or stay by their own text; extra columns keep their values."""
    rng = random.Random(1)
    good = [" ".join(f"word{rng.randrange(900)}" for _ in range(60)) for _ in range(300)]
    rows = [(i, t, "en", "s", len(t), "x", "x") for i, t in enumerate(good)]
    rows += [(7, "junk", "en", "s", 4, "x", "x"), (None, "junk", "en", "s", 4, "x", "x"), (None, good[0] + " end", "en", "s", 1, "x", "x")]
    rows += [(None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, kept string")
    found = dict(corpus_pipeline.STAGES)["quality_rules"](spark, frame, FOLDER)
    wanted = [r for r in rows if r[1] and r[1] != "junk"]
    assert found.columns == frame.columns and sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)


def test_stages_pass_columns_of_any_name_through(spark):
    """Columns named like those that stages work with come out as they went in."""
    names = ["n_lines", "n_dropped", "keep", "keep_bits", "bitmap_doc", "base_spans", "hidden_spans", "done", "others", "component_id", "gone_id", "rejected_id"]
    text = "a line that two documents share\nmail jo@ex.com"
    rows = [(i, f"{text} {i}", "en", "s", 1, *[f"{c} {i}" for c in names]) for i in range(3)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line_dedup"](spark, frame, FOLDER)
    private = stages["personal_data"](spark, lines, FOLDER)
    assert private.columns == frame.columns
    found = {r["doc_id"]: r for r in private.collect()}
    for i, *_, in rows:
        assert [found[i][c] for c in names] == [f"{c} {i}" for c in names]
    assert [found[i]["text"] for i in (0, 1)] == ["a line that two documents share\nmail <EMAIL> 0", "mail <EMAIL> 1"]
    assert stages["near_duplicates"](spark, frame, FOLDER).columns == frame.columns


def plain_roots(docs):
    """The smallest doc_id over links of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}))
    root = {i: i for i, _ in docs}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in sets:
        for j, b in sets:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def test_near_duplicates_equal_brute_force(spark):
    """Copies with words changed here and there, most of them more than two fingerprint bits apart; chains; short texts."""
    rng = random.Random(11)
    docs = [(0, None), (1, " "), (2, "one two"), (3, "One  TWO"), (4, "one two three")]
    for _ in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 100, 300]))]
        for _ in range(8):
            docs.append((len(docs), " ".join(words)))
            words = list(words) if rng.random() < 0.3 else words
            for _ in range(rng.choice([1, 1, 2, 6])):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    wanted = plain_roots(docs)
    assert 60 < sum(i != root for i, root in wanted.items()) < len(docs) - 60
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, FOLDER).collect()}
    assert kept == {i for i, root in wanted.items() if i == root}


def edited(rng, words, times):
    words = list(words)
    for at in rng.sample(range(len(words)), times):
        words[at] = f"v{rng.randrange(10**9)}"
    return " ".join(words)


def test_a_large_group_of_unlinked_near_copies_makes_no_square(spark, monkeypatch):
    """600 copies of one text with 4 to 9 of 150 words changed: hardly a pair is alike, and hardly one is proposed."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = [(i, edited(rng, base, rng.randrange(4, 10))) for i in range(600)]
    docs += [(600 + i, edited(rng, docs[i][1].split(), 1)) for i in range(40)]
    sizes = []
    proposed = near_copies._proposed
    monkeypatch.setattr(near_copies, "_proposed", lambda *a: sizes.append(proposed(*a)) or sizes[-1])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(frame).collect()}
    assert found == plain_roots(docs)
    assert sizes[0].count() < 200


def test_rows_that_repeat_or_lack_an_id(spark):
    """Of each group one row stays, whatever ids its rows have."""
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(3, a), (7, a), (7, b), (3, a), (None, c), (None, c), (None, b), (9, None), (None, ""), (3, c + " end")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, f"row {k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row_id string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, FOLDER)
    assert kept.columns == frame.columns
    found = sorted(((r["doc_id"], r["text"], r["row_id"]) for r in kept.collect()), key=repr)
    assert [f[:2] for f in found] == sorted([(3, a), (7, b), (9, None), (3, c + " end")], key=repr)
    assert all(rows[int(row.split()[1])] == (i, t) for i, t, row in found)
    ids = sorted(((r["doc_id"], r["component_id"]) for r in near_copies.near_copies(frame).collect()), key=repr)
    assert ids == sorted([(3, 3), (7, 3), (7, 7), (3, 3), (None, 3), (None, 3), (None, 7), (9, 9), (None, 9), (3, 3)], key=repr)
    assert near_copies.near_copies(frame.limit(0)).collect() == near_copies.keep(frame.limit(0)).collect() == []


@pytest.mark.parametrize("share, least", [(0.8, 0.97), (0.9, 0.97)])
def test_recall_of_links(spark, share, least):
    """Pairs made to be just alike enough are found."""
    rng = random.Random(int(share * 100))
    docs = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(404)]
        # Changed words 5 apart change 5 shingles each.
        times = int(400 * (1 - share) / (1 + share) / 5)
        other = [f"v{rng.randrange(10**9)}" if i % 6 == 5 and i // 6 < times else w for i, w in enumerate(words)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id <> component_id").count()
    assert found >= least * 150


@pytest.mark.parametrize("n, share", [(40, 0.8), (60, 0.95), (199, 0.95), (200, 0.95)])
def test_a_clean_small_source_of_another_style_is_kept(spark, n, share):
    """A source full of symbols beside one without any; the smaller it is, the more it leans on the other."""
    rng = random.Random(n)
    prose = [(i, " ".join(f"word{rng.randrange(900)}" for _ in range(80)), "en", "big") for i in range(1200)]
    code = [(5000 + i, " ".join(rng.choice(["#include", "a&b", "x*y", "<tag>", "if", "then", f"name{rng.randrange(900)}"]) for _ in range(80)), "en", "code") for i in range(n)]
    frame = spark.createDataFrame([(i, t, lang, source, len(t)) for i, t, lang, source in prose + code], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["quality_rules"](spark, frame, FOLDER).collect()}
    assert len(kept & {i for i, *_ in code}) > share * n and len(kept & {i for i, *_ in prose}) > 0.95 * 1200


def test_near_duplicates_come_from_fingerprints_joined_on_popcounts(spark, monkeypatch):
    """The closest copies are found by their SimHashes alone, those further apart by the steps behind."""
    rng = random.Random(8)
    docs, far = [], []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, edited(rng, words, 1))]
    for k in range(40, 60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        far += [(2 * k, " ".join(words)), (2 * k + 1, edited(rng, words, 3))]
    pairs = []
    found = near_copies._fingerprint_pairs
    monkeypatch.setattr(near_copies, "_fingerprint_pairs", lambda nodes: pairs.append(found(nodes)) or pairs[-1])
    frame = spark.createDataFrame(docs + far, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, FOLDER).collect()} == set(range(0, 120, 2))
    assert 20 <= pairs[0].count() < 60
