"""The training-data operators against brute force, on small inputs with nulls, ties, copies and long texts."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stowage.llm import components, decontaminate, jaccard, langid, mixing, packing, pii, queries, substrings, topk, toxicity, urls

DATA = "/root/testdata/sf0.001"
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def frame(spark, texts, first=0):
    rows = [(first + k, t, None, "src0", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


@pytest.fixture(scope="module")
def mixed():
    """Texts with copies, near copies, a common passage, junk, empty and null ones."""
    rng = random.Random(3)
    base = [prose(rng.randint(1, 120), rng) for _ in range(60)]
    passage = prose(70, rng)
    near = []
    for t in base[:25]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    shared = [prose(30, rng) + " " + passage + " " + prose(20, rng) for _ in range(6)]
    return [*base, *base[:10], *near, *shared, passage.upper(), None, "", "  \n", "one two", "one two", "De " * 90, "De " * 95, prose(6000, rng)]


# ---- op3, components


def sets_of(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def brute_components(texts):
    sets, parent = [sets_of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def test_jaccard_equals_brute_force(spark, mixed):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, mixed)).collect()}
    assert [got[k] for k in range(len(mixed))] == brute_components(mixed)


def test_jaccard_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base, texts = prose(80, rng).split(), []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = "x" + str(rng.randrange(10**6))
        texts.append(" ".join(own))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [c for _, c in brute_components(texts)]


def test_jaccard_empty_table(spark):
    assert jaccard.join(frame(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30) if k % 10] + [(5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {k: {0: 1, 1: 11, 2: 21}[(k - 1) // 10] for k in range(1, 31)}


# ---- op1


def test_repeats_finds_every_shared_passage(spark, mixed):
    rows = substrings.repeats(frame(spark, mixed)).collect()
    words = [(t or "").lower().split() for t in mixed]
    grams = {}
    for k, w in enumerate(words):
        for p in range(len(w) - 49):
            grams.setdefault(tuple(w[p : p + 50]), set()).add(k)
    must = {k for own in grams.values() if len(own) > 1 for k in own}
    assert must <= {r["doc_id"] for r in rows}
    for r in rows:
        a, b = words[r["doc_id"]][r["start"] : r["end"]], words[r["other_id"]][r["other_start"] : r["other_end"]]
        assert min(len(a), len(b)) >= 50 and r["doc_id"] != r["other_id"]
        if r["identity"] == 1:
            assert a == b


def test_repeats_names_all_pairs_of_a_small_run(spark):
    rng = random.Random(21)
    passage = prose(60, rng)
    texts = [prose(20, rng) + " " + passage + " " + prose(20, rng) for _ in range(8)]
    pairs = {(r["doc_id"], r["other_id"]) for r in substrings.repeats(frame(spark, texts)).collect()}
    assert pairs == {(a, b) for a in range(8) for b in range(8) if a != b}


def test_repeats_links_all_holders_of_large_runs(spark):
    rng = random.Random(22)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base, line = own(400), own(20)
    # sliding windows of one text: each of its words lies in 18 documents or so, those next to each other share 53 words
    texts = [" ".join(own(30) + base[3 * k : 3 * k + 56] + own(30)) for k in range(100)]
    # two passages behind one line; all others hold the line alone
    first, second = own(50), own(50)
    texts += [" ".join(own(15) + line + tail + own(15)) for tail in (first, second) for _ in range(20)]
    texts += [" ".join(own(40) + line + own(40)) for _ in range(40)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rows = substrings.repeats(frame(spark, texts)).collect()
    for r in rows:
        parent[find(r["doc_id"])] = find(r["other_id"])
    groups = [range(100), range(100, 120), range(120, 140)]
    assert [len({find(k) for k in g}) for g in groups] == [1, 1, 1]
    assert {r["doc_id"] for r in rows} == set(range(140))
    for r in rows:
        assert texts[r["doc_id"]].split()[r["start"] : r["end"]] == texts[r["other_id"]].split()[r["other_start"] : r["other_end"]] or r["identity"] < 1


def test_edits_of_many_differences():
    rng = random.Random(23)
    for _ in range(200):
        x, y = ([rng.randrange(9) for _ in range(rng.randint(1, 30))] for _ in range(2))
        row = list(range(len(y) + 1))
        for k, a in enumerate(x):
            new = [k + 1]
            for j, b in enumerate(y):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        for most in (2, 30):
            assert substrings._edits(np.array(x), np.array(y), most) == min(row[-1], most + 1)


def test_repeats_leaves_clean_documents_alone(spark):
    rng = random.Random(11)
    texts = [prose(200, rng) + " " + prose(0, rng) for _ in range(20)] + ["a common line of ten words that many texts hold " + prose(100, rng) for _ in range(5)]
    assert substrings.repeats(frame(spark, texts)).count() == 0
    assert substrings.repeats(frame(spark, [])).count() == 0


def test_chain_prefers_ordered_segments():
    segments = np.array([[0, 10, 0, 10], [100, 130, 12, 42], [12, 40, 14, 42]])
    assert substrings.chain(segments)[0] in ([0, 2], [1])


@pytest.mark.parametrize("gap", [50, 100, 150])
def test_repeats_cuts_chains_across_different_words(spark, gap):
    rng = random.Random(gap)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    head, foot = own(60), own(60)
    texts = [" ".join([own(5), head, own(gap), foot, own(5)]) for _ in range(2)]
    rows = substrings.repeats(frame(spark, texts)).collect()
    at = [(5, 65), (65 + gap, 125 + gap)]
    assert sorted((r["doc_id"], r["start"], r["end"], r["other_start"], r["other_end"], r["identity"]) for r in rows) == [(d, a, b, a, b, 1.0) for d in (0, 1) for a, b in at]


# ---- op2

CASES = [None, "", "a@b.co@c.de x@y", "mail a.b+1@x-y.example.com.", "1.2.3.4.5.6.7.8 and 300.1.1.1 and 001.02.3.4", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (446) 555-8962 x +12 +1234567 é +49.30.123456", "1" * 5000 + "." + "a." * 3000 + "a@" + "b." * 2000 + "c", "a@b.c_d@e.fg", "\U0001f600 x@y.zz \U0001f600"]


def brute_spans(text):
    text, out = text or "", []
    luhn = lambda d: sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for kind, (pattern, valid) in rules.items():
        if kind == "email" and "@" not in text:
            continue
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if valid(m.group())]
    return out


def test_pii_base_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in pii.summary(pii.find(frame(spark, CASES))).collect()}
    for k, text in enumerate(CASES):
        spans = brute_spans(text)
        assert rows[k]["spans"] == ",".join(spans), k
        assert rows[k]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert rows[k]["n_email"] == sum(s.startswith("email") for s in spans)


def test_pii_bootstraps_contexts(spark):
    texts = [f"please call +1 (446) 555-{1000 + k} today" for k in range(12)] + ["please call ext-77-9912 today", "the year 19988 was good", "the year 19989 was good"]
    rows = {r["doc_id"]: r["spans"] for r in pii.summary(pii.find(frame(spark, texts))).collect()}
    assert "context:12:23" in rows[12] and rows[13] == "" and rows[14] == ""


def test_pii_discovered_instances_support_new_contexts(spark):
    tokens = [f"id-{k}-77" for k in range(20)]
    edges = [("call", f"+1 446 555-{k}", True) for k in range(1000, 1500)] + [("call", t, False) for t in tokens]
    edges += [("ring", t, False) for t in [*tokens, "zz-1-1"]] + [("year", f"19{k}", False) for k in range(10)] + [("page", tokens[0], False)]
    mentions = spark.createDataFrame(edges, "context string, token string, seed boolean")
    assert {r["context"] for r in pii.believed_contexts(mentions).collect()} == {"call", "ring"}


def test_pii_seeds_from_addresses_without_digits(spark):
    texts = [f"mailbox {c}x@example.com today" for c in "abcdefghijkl"] + ["mailbox id-77-99 today"]
    rows = {r["doc_id"]: r["spans"] for r in pii.summary(pii.find(frame(spark, texts))).collect()}
    assert rows[0] == "email:8:22" and rows[12] == "context:8:16"


def test_redact_keeps_rows_and_columns(spark):
    docs = frame(spark, [*CASES[:7], "mail a@b.cc now", "mail a@b.cc now"])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(rows) == 9 and rows[0] is None and rows[7] == "mail [EMAIL] now" and "@b.co" not in rows[2]


# ---- op4


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/7?x"), (2, "https://a.example.net/de/81#t"), (3, "x.org/es/"), (4, None), (5, "ftp://q.org/es/1"), (5, "ftp://q.org/es/1"), (6, "http://zzz.info"), (7, "http://example.net/de/9"), (8, "http://examplecom/en/7"), (9, "http://.com://x/en/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("www.example.com", "/en/7", "example.com/en/7") and got[2] == ("a.example.net", "/de/81", "example.net/de/8")
    assert got[3] == ("", "", None) and got[4] == ("", "", None) and got[5][2] == "org/es/" and got[6] == ("zzz.info", "", None) and got[7][2] == "net/de/" and got[8][2] is None
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_ratio_separates_the_ruled(spark):
    rows = [(k, f"http://good{k}.example.net/de/{k}" if k % 2 else f"http://bad{k}.example.org/es/{k}") for k in range(60)]
    rows += [(100, "http://good1.example.net/dex/5"), (101, "http://bad3.example.org/esx/5")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[100] == "allow" and got[101] == "block"


# ---- op5, op6


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 1.0, "kill": 1.5})
    score = lambda t: sum(g.clauses(t)[0])
    assert score("you idiot") > score("an idiot") > score("he said idiot things") > 0
    assert score("not an idiot") < score("an idiot") and score("not so. an idiot") == score("an idiot")
    assert score("kill you") < score("you kill") and score(None) == score("") == 0
    assert score("an idiot idiot") > 2 * score("an idiot") and score("i kill an idiot") > score("i kill") + score("an idiot")


def test_grammar_equals_transducers_run_apart():
    """The composed table scores a clause as its parts do, one after another."""
    rng, grammar = random.Random(8), toxicity.Grammar({"idiot": 1.0, "kill": 1.5})
    words = {"idiot": toxicity.INSULT, "kill": toxicity.THREAT, "you": toxicity.TARGET, "not": toxicity.NEGATION, "said": toxicity.REPORT, "table": None}
    weights = {"idiot": 1.0, "kill": 1.5}
    for _ in range(300):
        clause = [rng.choice(list(words)) for _ in range(rng.randint(1, 9))]
        states, total, reached = [0] * 5, 0.0, None
        parts = (toxicity._negation, toxicity._report, toxicity._target, toxicity._insult, toxicity._threat)
        for at, word in enumerate(clause):
            if words[word] is None:
                continue
            if states[0] and at - reached > toxicity.NEGATION_REACH:
                states = [f(s, toxicity.GAP)[0] for f, s in zip(parts, states, strict=True)]
            steps = [f(s, words[word]) for f, s in zip(parts, states, strict=True)]
            states = [s for s, _ in steps]
            total += weights.get(word, 0.0) * math.prod(w for _, w in steps)
            reached = at if word == "not" else reached
        assert sum(grammar.clauses(" ".join(clause))[0]) == pytest.approx(total)


def test_toxicity_learns_labels(spark):
    texts = [prose(20) + (" you zorgling fool " if k % 3 == 0 else " ") + prose(10) for k in range(300)] + [None, ""]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(1, None)], "doc_id long, toxic int")
    docs = frame(spark, texts)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).collect()}
    assert len(got) == 302 and all((got[k] >= 0.3) == (k % 3 == 0) for k in range(300)) and got[300] < 0.3
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).count() == 302


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = queries.op6_langid(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.9
    model = langid.fit(docs, F.lit(True))
    odd = langid.identify(frame(spark, [None, "", "123 !!", "²", "the and of"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd[:4]] == ["und"] * 4 and odd[4]["lang_pred"] != "und"
    assert langid.identify(frame(spark, ["abc"]), langid.fit(docs, F.lit(False))).first()["lang_pred"] == "und"


# ---- op7


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(v) for v in rng.normal(size=8) / 2] for _ in range(150)]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(150, None), (160, [float("nan")] * 8), (180, [1.0, None] * 4), (200, vectors[3]), (None, vectors[4]), (3, vectors[3])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 20).collect()
    x = {k: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for k, v in enumerate(vectors)} | {200: None}
    x[200] = x[3]
    listed = [*x.items(), (3, x[3])]
    for q in [*range(0, 150, 20), 200]:
        expected = sorted((-int(x[q] @ v), k) for k, v in listed if k != q)[:20]
        assert [(r["score"], r["id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(-s, k) for s, k in expected]
    assert {r["query_id"] for r in got} == {*range(0, 150, 20), 200}


def test_topk_stops_only_on_proof():
    """Same rows as brute force; of skewed vectors a part of the postings is read, and blocks of short vectors none."""
    rng = np.random.default_rng(2)
    even, ids = rng.integers(-40, 40, (3000, 16)), np.arange(3000)
    skewed = (even * rng.pareto(1.2, (3000, 1)) * (rng.random((3000, 16)) < 0.4)).astype(np.int64)
    shares = {}
    for name, x in (("even", even), ("skewed", skewed)):
        block, read = topk.Block.of(ids, x), 0
        for q in range(60):
            found, scores, n = topk.search(q, x[q], block, 5)
            expected = sorted((-int(x[q] @ v), k) for k, v in enumerate(x) if k != q)[:5]
            assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == expected
            read += n
        shares[name] = read / 60 / np.count_nonzero(x)
    assert shares["skewed"] < 0.5 and shares["even"] <= 1
    short = topk.Block.of(ids, even // 20)
    assert topk.search(-1, even[0], short, 5, floor=10**6)[2] == 0


def test_topk_floor_keeps_ties():
    x = np.array([[3, 4], [3, 4], [4, 3], [0, 1], [5, 0]])
    block = topk.Block.of(np.arange(5), x)
    found, scores, _ = topk.search(9, np.array([1, 1]), block, 2, floor=7)
    assert found.tolist() == [0, 1] and scores.tolist() == [7, 7]


def test_topk_queries_read_a_block_together():
    """Same rows as brute force for even, skewed, sparse, repeated and huge components, with and without floors; a block of queries in one go."""
    rng = np.random.default_rng(4)
    even = rng.integers(-40, 40, (1500, 12))
    kinds = {
        "even": even,
        "skewed": (even * rng.pareto(0.7, (1500, 1))).astype(np.int64),
        "sparse": np.where(rng.random(even.shape) < 0.02, even * 1000, even // 16),
        "copies": np.where(rng.random((1500, 1)) < 0.5, even[:1], even),
        "huge": even * 2**23,
    }
    ids, k = np.sort(rng.integers(0, 3000, 1500)), 20
    for name, x in kinds.items():
        block, asked = topk.Block.of(ids, x), rng.integers(0, 1500, 40)
        expected = []
        for q in asked:
            scores = x @ x[q]
            expected.append([(int(ids[i]), int(scores[i])) for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k])
        for floors in (np.full(40, topk.NO_FLOOR), np.array([e[-1][1] for e in expected])):
            row, found, scores = topk.best_rows(*topk.search_all(ids[asked], x[asked], block, k, floors), k)
            for q, e in enumerate(expected):
                assert list(zip(found[row == q].tolist(), scores[row == q].tolist(), strict=True)) == e, name
    x = np.floor(rng.normal(size=(8192, 64)) * 8).astype(np.int64)
    block, began = topk.Block.of(np.arange(8192), x), time.process_time()
    topk.search_all(np.arange(2048), x[:2048], block, k, np.full(2048, topk.NO_FLOOR))
    assert time.process_time() - began < 8


def test_topk_huge_components_and_empty_table(spark):
    rows = [(k, [float(v) * 2.0**28, 1.0], "clash") for k, v in enumerate((3, -5, 7, 7))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [(r["query_id"], r["rank"], r["id"]) for r in topk.top_k(vectors, F.col("vec_id") == 0, k=2, scale=1).collect()]
    assert sorted(got) == [(0, 1, 2), (0, 2, 3)]
    assert topk.top_k(vectors.limit(0), F.lit(True)).count() == 0


# ---- op8


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    items = [prose(25, rng) for _ in range(6)] + [None, " ", "tiny"]
    texts = [None, ""]
    for k in range(24):
        hit = list(items[k % 6])
        for _ in range(k // 2):
            hit[rng.randrange(len(hit))] = rng.choice("abcxyz ")
        texts.append(prose(15, rng).upper() + "\n " + "".join(hit).title() + "  " + prose(15, rng))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_items(frame(spark, texts), table, block_chars=200).collect()}
    expected = {}
    for d, t in enumerate(texts):
        clean = decontaminate.normalise(t)
        for i, item in enumerate(items):
            own = decontaminate.normalise(item)
            if clean and own and (e := distance_in(own, clean)) <= min(int(len(own) * decontaminate.RATE), len(own) - 1):
                expected[d, i] = e
    assert got == expected
    assert decontaminate.find_items(frame(spark, []), table).count() == 0
    assert decontaminate.find_items(frame(spark, texts), table.limit(0)).count() == 0


# ---- op9


def test_base_score_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "VOCABULARY", 40)
    texts = [prose(RNG.randint(0, 60)).title() for _ in range(80)] + [None, "", "never-seen Words", "a b \x1fc"]
    texts += texts[:5]
    docs = frame(spark, texts).repartition(3)
    rows = mixing.score(docs, F.col("doc_id") % 4 != 1).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter(w for k, t in enumerate(texts) if k % 4 != 1 for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own), abs=1e-8)
        assert r["score"] < 0


def test_mixing_is_a_code(spark):
    """Different token sequences share at most the whole probability; known text costs less than noise."""
    known = [prose(60) for _ in range(150)]
    letters = ["", *[chr(k) for k in range(33, 127) if not 65 <= k <= 90], *[f"{a} {b}" for a in "ab" for b in "abcdef"], *VOCABULARY]
    noise = " ".join("".join(RNG.choices("qwxyz0123456789", k=6)) for _ in range(60))
    texts = [*known, *letters, known[3], noise]
    held_out = len(known)
    rows = {r["doc_id"]: r for r in mixing.score(frame(spark, texts), F.col("doc_id") < held_out).collect()}
    assert sum(10 ** rows[held_out + k]["score"] for k in range(len(letters))) <= 1
    seen, strange = rows[len(texts) - 2], rows[len(texts) - 1]
    assert seen["score"] / len(known[3]) > 3 * strange["score"] / len(noise)
    assert seen["score"] > seen["base_score"]


def test_mixing_fits_on_the_fitting_texts_alone(spark):
    """Only their texts travel to be fitted on, and they are told the same as beside all others."""
    rng = random.Random(8)
    docs = frame(spark, [prose(rng.randint(1, 200), rng) for _ in range(200)] + ["", None]).select("doc_id", "text").coalesce(1)
    (row,) = mixing._pack(docs, F.lit(True)).toArrow().to_pylist()
    (small,) = (r for b in mixing._fitting(iter([pa.RecordBatch.from_pylist([row])])) for r in b.to_pylist())
    whole, part = mixing.read_batch(row), mixing.read_batch(small)
    assert 0 < len(part.sizes) < len(whole.sizes) / 4 and part.fit.all()
    assert small["ids"] == [i for i, fit in zip(row["ids"], whole.fit, strict=True) if fit] and small["batch"] == row["batch"]
    assert part.unique[part.token].tolist() == whole.unique[whole.token][whole.fit[whole.text]].tolist()
    assert part.unique.tolist() == whole.unique[whole.count(whole.fit) > 0].tolist()


def test_mixing_without_training(spark):
    docs = frame(spark, ["a b", None])
    rows = mixing.score(docs, F.lit(False)).collect()
    assert [r["n_known"] for r in rows] == [0, 0] and all(r["train_tokens"] == 0 and -1000 < r["score"] < 0 for r in rows)
    assert mixing.score(docs.limit(0), F.lit(True)).count() == 0


def test_tree_is_complete_and_counts_are_those_of_its_nodes():
    rng = np.random.default_rng(3)
    tree, number = mixing.Tree.build(rng.integers(1, 100, 50))
    assert sum(2.0**-n for n in tree.lengths) == 1 and sorted(number) == list(range(50))
    low = np.uint64(64 - 40 - mixing.SYM_BITS)
    keys = np.unique(rng.integers(0, 6, 120).astype(np.uint64) << np.uint64(64 - 40) | rng.integers(0, 50, 120).astype(np.uint64) << low)
    counts = rng.integers(0, 4, len(keys))
    lengths, cells = mixing._paths(keys, counts, tree, mixing.TOP, 40)
    path = lambda s: [int(tree.codes[s]) >> (mixing.TOP - 1 - d) & 1 for d in range(tree.lengths[s])]
    split = [(int(k) >> 24, path(int(k) >> int(low) & ((1 << mixing.SYM_BITS) - 1))) for k in keys]
    at = 0
    for (context, own), n in zip(split, lengths, strict=True):
        expected = []
        for d in range(len(own)):
            below = [(p, c) for (x, p), c in zip(split, counts, strict=True) if x == context and p[:d] == own[:d]]
            total = sum(c for _, c in below)
            if not total:
                break
            expected.append(int(mixing._quantised(np.array([sum(c for p, c in below if p[d] == own[d])]), np.array([total]))[0]))
        assert n == len(expected) and cells[at : at + n].tolist() == expected
        at += n


# ---- op10


def test_packing_round_trip(spark, mixed):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    odd = ["It's o'clock.'s Σας İx. ÉA", "\x1c a\x1db <|endoftext|> c", "12.5, 3...y!?"]
    texts = [*mixed, *odd]
    rows = packing.pack(frame(spark, texts), path, window=256, block=2000).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == np.array(ids, "<u4").tobytes()
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:n]) for n in range(len(pieces))]
        assert all(r["doc_tokens"] == len(ids) for r in pieces)
    first = rows[0]
    assert packing.digest(packing.pack(frame(spark, texts[:1]), path)).first()["ids_crc32"] == zlib.crc32(np.array(tokenizer.encode(texts[0]).ids + [1], "<u4").tobytes()) or first is None
    assert packing.pack(frame(spark, []), path).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(4)
    positions = np.array([0, *sorted(rng.sample(range(1, 60), 25)), 60])
    penalties = np.array([0.0, *[rng.choice([0.0, 2.0]) for _ in range(25)], 0.0])
    window = 12
    if np.diff(positions).max() > window:
        positions, penalties = np.arange(61), np.zeros(61)

    def best(j):
        if j == 0:
            return 0.0
        return min(best(i) + (packing.padding(positions[j] - positions[i], window) if j == len(positions) - 1 else window - (positions[j] - positions[i]) + penalties[j]) for i in range(j) if positions[j] - positions[i] <= window)

    import functools

    best = functools.cache(best)
    cuts = packing.choose_cuts(positions, penalties, window, True)
    at, cost = 0, 0.0
    for c in cuts:
        cost += packing.padding(c - at, window) if c == positions[-1] else window - (c - at) + penalties[list(positions).index(c)]
        at = c
    assert cost == best(len(positions) - 1)


# ---- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_whole(spark, name):
    rows = queries.queries()[name](spark, DATA)
    assert len(rows.columns) == len(set(rows.columns))
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name.split("_")[0] in ("op2", "op3", "op5", "op6", "op9"):
        assert rows.count() == n
    else:
        assert rows.count() > 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in current.collect()}
        current = stage(spark, current, DATA).cache()
        assert current.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in current.collect()}
        gone = before - set(after)
        if name == "near_duplicates":
            ids = sorted(before)
            groups = dict(zip(ids, (ids[c] for _, c in brute_components([kept[i] for i in ids])), strict=True))
            assert gone == {i for i in ids if groups[i] != i}
        if name == "leaks":
            found = decontaminate.find_items(docs, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert gone == {r["doc_id"] for r in found.collect()} & before
        if name == "private_data":
            assert not gone and all(not brute_spans(t) for t in after.values())
    pieces = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(after)


def test_pipeline_leaves_untouched_texts_in_place(spark, tmp_path):
    """Texts that keep their row as it is meet a broadcast filter alone, so they are not dealt out."""
    import corpus_pipeline

    rng = random.Random(5)
    texts = [prose(40, rng) for _ in range(12)]
    frame(spark, [*texts, texts[2], "mail some.one@example.com now"]).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage in (corpus_pipeline.near_duplicates, pii_redacted):
        out = stage(spark, docs, str(tmp_path))
        plan = out._jdf.queryExecution().optimizedPlan()
        assert plan.nodeName() == "Union"
        first = plan.children().apply(0).toString()
        assert first.count("Join ") == first.count("strategy=broadcast") == 1 and "Aggregate" not in first
        assert sorted(r["doc_id"] for r in out.collect()) == [k for k in range(14) if k != 12 or stage is pii_redacted]


def pii_redacted(spark, docs, sf_dir):
    return pii.redact(docs)


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = rng.integers(0, 1 << 62, 400).astype(np.uint64)
        n = int(rng.integers(1, 200))
        x = np.unique(pool[:n])
        y = np.unique(np.concatenate([x[int(rng.integers(0, 1 + n // 4)) :], pool[300 : 300 + int(rng.integers(0, 1 + n // 3))]]))
        if not len(y):
            continue
        common = len(np.intersect1d(x, y))
        if 100 * common >= 75 * (len(x) + len(y) - common):
            assert jaccard.may_link(jaccard.sketch(x), jaccard.sketch(y), len(x), len(y), 75)


def test_jaccard_blocks_hold_little_but_tokens(mixed):
    """Beside four bytes a token, a text's entry in a bucket is its node and one or two bytes each for its size and count."""

    class Frequent:
        value = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    texts = pa.RecordBatch.from_arrays([pa.array(mixed)], ["text"])
    rows = [r for b in jaccard._prefixes(5, 75, 1, Frequent)(iter([texts])) for r in b.to_pylist()]
    assert len(rows) == jaccard.ORDERS
    for r in rows:
        n = len(r["nodes"]) // 8
        assert len(r["sizes"]) + len(r["counts"]) <= 4 * n
        counts = jaccard._widened([r["counts"]], [n])
        assert counts.sum() == len(r["tokens"]) // 4
        assert counts.tolist() == [jaccard.prefix_length(m, 75) for m in jaccard._widened([r["sizes"]], [n]).tolist()]


def test_jaccard_buckets_are_sorted_in_parts(spark, monkeypatch, mixed):
    monkeypatch.setattr(jaccard, "PART_TOKENS", 50)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, mixed)).collect()}
    assert [got[k] for k in range(len(mixed))] == brute_components(mixed)


def test_pipeline_bounds_the_bytes_of_arrow_batches(spark, tmp_path):
    """Texts are of any length: a stage's Python workers get a bounded number of bytes at once, not of rows."""
    import corpus_pipeline

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = frame(spark, [prose(100_000, random.Random(k)) for k in range(24)]).coalesce(1)
    for _, stage in corpus_pipeline.STAGES[:1]:
        stage(spark, docs, str(tmp_path)).count()
    sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert len(sizes) > 1 and max(r["n"] for r in sizes) < 6_000_000


@pytest.mark.parametrize("n", [0, 1, 5, 40])
def test_jaccard_runs_in_blocks(spark, monkeypatch, n):
    """Runs above the block size meet in blocks; documents outside the main group find the partner they have."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 8)
    rng = random.Random(n)
    base = prose(60, rng).split()
    texts = []
    for _ in range(40):
        own = list(base)
        own[rng.randrange(60)] = "x" + str(rng.randrange(10**6))
        texts.append(" ".join(own))
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(60), 4 + k % 6):
            own[at] = "y" + str(rng.randrange(10**6))
        texts.append(" ".join(own))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [c for _, c in brute_components(texts)]


@pytest.mark.parametrize("changed", [20, 26])
def test_jaccard_large_groups_give_fewer_links_than_nodes(spark, monkeypatch, changed):
    """Two groups of copies just above or below the threshold: neither sketches nor links give the square of a group."""
    rng, rows, write = random.Random(changed), [], jaccard.materialize

    def counted(df, label):
        out = write(df, label)
        rows.append((label, out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    base = prose(200, rng).split()
    other = base[:80] + [f"z{k}" for k in range(changed)] + base[80 + changed :]
    texts = [" ".join([*words, f"y{side}{k}"]) for side, words in enumerate((base, other)) for k in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [c for _, c in brute_components(texts)]
    assert max(n for label, n in rows if label in ("jaccard-cross", "jaccard-live")) <= len(texts)


@pytest.mark.parametrize("capital", ["İ", "Σ", "İ̇"])
def test_word_ids_equal_the_tokeniser(capital):
    rng, table = random.Random(ord(capital[0])), packing.word_ids(queries.tokenizer_path())
    alphabet = ["a", "b", "Z", "é", "É", "ß", "ñ", "×", capital, "̇", "́", "1", "2", ".", ",", "'", "'s", ";", "-", " ", "  ", "\n", "\t", "\x00", "\x1c", "\x85", " ", " ", "<", "|", ">"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    assert [x.tolist() for x in table.encode_all(texts)] == [table.whole(t).tolist() for t in texts]


def test_edits_equal_the_table():
    rng = random.Random(2)
    for _ in range(400):
        x, y = ([rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
        assert substrings._edits(np.array(x), np.array(y), 99) == row[-1]


def test_pii_finds_keys_between_quotes(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(8)]
    texts = [f'then token = "{k}" and so on' for k in keys] + ['here token = "short-77-key" too', 'License, version 3. "quoted 99-11" text', 'colour = "red-1234"']
    rows = {r["doc_id"]: r["spans"] for r in pii.summary(pii.find(frame(spark, texts))).collect()}
    assert rows[0] == "context:14:54" and rows[8] == "context:14:26" and rows[9] == "" and rows[10] == ""


def test_pii_rounds_equal_plain_python(spark):
    rng = random.Random(6)
    edges = list({(f"c{rng.randrange(12)}", f"t{rng.randrange(60)}", rng.random() < 0.0) for _ in range(260)})
    seeds = {f"t{k}" for k in range(25)}
    edges = [(c, t, t in seeds) for c, t, _ in edges if not (c in ("c1", "c2") and int(t[1:]) > 27)]
    belief = {(c, t): float(s) for c, t, s in edges}

    def judged():
        out = {}
        for c in {c for c, _, _ in edges}:
            own = [v for (x, _), v in belief.items() if x == c]
            if sum(own) >= pii.LEAST_SEEDS and sum(own) / (len(own) + 1) >= pii.CONFIDENCE:
                out[c] = sum(own) / (len(own) + 1)
        return out

    for _ in range(pii.ROUNDS):
        good, best = judged(), {}
        for c, t, _ in edges:
            if c in good:
                best[t] = max(best.get(t, 0.0), good[c])
        belief = {(c, t): max(float(s), best.get(t, 0.0)) for c, t, s in edges}
    rows = pii.believed_contexts(spark.createDataFrame(edges, "context string, token string, seed boolean")).collect()
    assert {r["context"]: pytest.approx(r["confidence"]) for r in rows} == judged()


def test_pii_many_matches_in_one_text(spark):
    text = " ".join(f"a{k}@example.com" for k in range(3000))
    row = pii.summary(pii.find(frame(spark, [text]))).first()
    assert row["n_email"] == 3000 and row["base_sha256"] == hashlib.sha256(",".join(brute_spans(text)).encode()).hexdigest()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, copies, repeated ids, a benchmark text, personal data, a clashing column, and no rows at all."""
    import corpus_pipeline

    rng = random.Random(21)
    good = [prose(80, rng) for _ in range(30)]
    item = prose(30, rng)
    long = prose(9000, rng)
    texts = [*good, good[3], good[4] + " more", None, "", "12 34 !!", "intro " + item + " outro", "mail some.one@example.com " + good[5][::-1], long]
    rows = [(k, t, "en", "src0", len(t or ""), 1.0) for k, t in enumerate(texts)] + [(7, good[7], "en", "src0", 1, 1.0), (None, prose(50, rng), "en", "src0", 1, 1.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in pieces}
    assert kept >= {*range(30), 36, 37, None} and not kept & {30, 31, 32, 33, 34, 35}
    assert sum(r["start"] == 0 for r in pieces if r["doc_id"] == 7) == 1
    masked = corpus_pipeline.private_data(spark, docs.where("doc_id = 36"), str(tmp_path)).first()
    assert masked["text"].startswith("mail [EMAIL] ") and masked["n_chars"] == len(masked["text"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
