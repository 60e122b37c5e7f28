"""Operators on documents against plain restatements, and their defined cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
import regex
from llm_fixtures import documents, odd_documents, prose
from pyspark.sql import functions as F

from retailweave.llm import icws, leaks, line_templates, pfair, pii, pu_quality, token_counts
from retailweave.llm.graph import connected_components
from retailweave.llm.words import WordHashes, shingles, words


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# --- leaks -----------------------------------------------------------------------------------------------------------


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_leaks(text, items, n=10):
    found, hit, ids = plain_words(text), set(), set()
    for item, item_text in items:
        own = plain_words(item_text)
        size = min(n, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(found) - size + 1 if size else 0):
            if tuple(found[i : i + size]) in windows:
                hit.update(range(i, i + size))
                ids.add(item)
    return len(found), len(hit), sorted(ids)


def leak_tables(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([1, 4, 9, 10, 11, 30]))) for i in range(30)]
    items += [(30, items[5][1]), (31, ""), (32, None), (33, "!!! ..."), (34, "Été, ÉTÉ 12")]
    rows = []
    for i in range(60):
        text = prose(rng, rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            part = (rng.choice(items)[1] or "").split()
            start = rng.randrange(len(part) + 1)
            text += " " + ", ".join(part[start:] if rng.random() < 0.5 else part).upper()
            text += "\n" + prose(rng, rng.randrange(6))
        rows.append((i, text))
    rows += [(60, None), (61, ""), (62, "été ÉTÉ 12 été, ÉTÉ 12"), (3, rows[3][1])]
    return rows, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("part_bytes", [1 << 20, 600])
def test_leaks_match_brute_force(spark, part_bytes):
    rows, items, benchmark = leak_tables(spark)
    found = leaks.find_leaks(documents(spark, rows), benchmark, part_bytes=part_bytes).collect()
    got = Counter((r["doc_id"], r["leak"]["n_words"], r["leak"]["n_hit"], tuple(r["leak"]["items"])) for r in found)
    want = Counter()
    for doc, text in rows:
        n_words, n_hit, ids = plain_leaks(text, items)
        want[doc, n_words, n_hit, tuple(ids)] += 1
    assert got == want
    assert all(r["leak"]["n_hit"] == sum(b - a + 1 for a, b in r["leak"]["spans"]) for r in found)


def test_cut_documents_hold_no_leak(spark):
    rows, items, benchmark = leak_tables(spark)
    rows.append((99, "one " + " ".join(items[0][1].split()) + " two"))
    docs = documents(spark, rows)
    cut = leaks.remove_leaks(docs, benchmark)
    assert cut.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(plain_leaks(text, items)[1] == 0 for text in left.values())
    for doc, text in rows:
        if plain_leaks(text, items)[1] == 0:
            assert left[doc] == text
    whole = leaks.remove_leaks(docs, benchmark, how="documents")
    assert {r["doc_id"] for r in whole.collect()} == {d for d, t in rows if plain_leaks(t, items)[1] == 0}


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_items_without_an_id_hit_words(spark, part_bytes):
    benchmark = spark.createDataFrame([(None, "one two three"), (None, "six seven eight"), (4, "eight nine")], "item_id long, text string")
    docs = documents(spark, [(1, "zero one two three four"), (2, "six seven eight nine ten"), (3, "one three")])
    found = {r["doc_id"]: r["leak"] for r in leaks.find_leaks(docs, benchmark, part_bytes=part_bytes).collect()}
    assert [(found[i]["n_hit"], found[i]["items"]) for i in (1, 2, 3)] == [(3, []), (4, [4]), (0, [])]
    left = {r["doc_id"]: r["text"] for r in leaks.remove_leaks(docs, benchmark, part_bytes=part_bytes).collect()}
    assert "two" not in left[1] and left[3] == "one three"


def test_leaks_defined_cases(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, "one short line"), (None, "a text")], "item_id long, text string")
    found = leaks.find_leaks(odd, benchmark)
    assert found.count() == odd.count()
    assert found.columns == [*odd.columns, "leak"]
    assert leaks.find_leaks(empty, benchmark).count() == 0
    assert leaks.find_leaks(odd, benchmark.limit(0)).where("leak.n_hit > 0").count() == 0
    assert leaks.remove_leaks(odd, benchmark).where("text is null").count() == 2


# --- near-duplicates -------------------------------------------------------------------------------------------------


def test_words_and_shingles():
    assert words("Ab-c É9\u00a0x".encode()) == ["ab".encode(), b"c", "É9\u00a0x".encode()]
    assert words(None) == words(b" .,") == []
    hashes = WordHashes()
    assert len(shingles(hashes.of([b"a"] * 3), 5)) == 1
    assert len(shingles(hashes.of([b"a", b"b"] * 4), 5)) == 4
    assert len(shingles(hashes.of([]), 5)) == 0


def edited(rng, text, changes):
    parts = text.split()
    for _ in range(changes):
        parts[rng.randrange(len(parts))] = prose(rng, 1)
    return " ".join(parts)


def near_rows(rng):
    rows = []
    for _ in range(40):
        text = prose(rng, rng.randrange(40, 300))
        rows.append(text)
        for _ in range(rng.randrange(4)):
            rows.append(edited(rng, text, rng.randrange(0, 6)))
    base = prose(rng, 200)
    rows += [edited(rng, base, rng.randrange(5)) for _ in range(60)]
    shared = prose(rng, 60)
    rows += [shared + " " + prose(rng, rng.randrange(20, 60)) for _ in range(30)]
    rows += ["", None, "three little words", "Three little, words!", "..."]
    rng.shuffle(rows)
    return list(enumerate(rows))


def components_of(n, links):
    owner = list(range(n))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        owner[b] = a
    return [root(i) for i in range(n)]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(11)
    rows = near_rows(rng)
    found = icws.near_duplicates(documents(spark, rows)).collect()
    # the same weights, over all pairs
    hashes = WordHashes()
    sets = [np.unique(shingles(hashes.of(words((t or "").encode())), 5)) for _, t in rows]
    families = {int(s.min()): i for i, s in reversed(list(enumerate(sets))) if len(s)}
    sketch = np.zeros(icws.SKETCH_ROWS << icws.SKETCH_BITS)
    for i in families.values():
        for cells in icws._cells(sets[i]):
            np.add.at(sketch, cells, 1)
    idf = icws.Idf(sketch, len(families))
    weighted = [icws.weighted_set((t or "").encode(), hashes, idf) for _, t in rows]
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a + 1, len(rows))
        if len(sets[a]) and icws.weighted_jaccard(weighted[a], weighted[b]) >= icws.SIMILARITY
    ]
    want = components_of(len(rows), links)
    assert {r["doc"]: r["component"] for r in found} == dict(enumerate(want))
    assert {r["doc"] for r in found if r["kept"]} == set(want)


@pytest.mark.parametrize("block", [5, 1024])
def test_crowds_near_the_threshold_make_no_pair_rows(spark, monkeypatch, block):
    rng = random.Random(3)
    rows = []
    for i in range(140):  # edits of one text, which share 0.7 to 0.9 of its shingles
        parts = prose(random.Random(9), 160).split()
        for at in rng.sample(range(len(parts)), rng.choice([2, 3, 3, 4])):
            parts[at] = f"x{i}"
        rows.append((i, " ".join(parts)))
    made, write = {}, icws._written
    monkeypatch.setattr(icws, "_written", lambda s, df, label: made.setdefault(label, write(s, df, label)))
    monkeypatch.setattr(icws, "BLOCK_ROWS", block, raising=False)
    found = {r["doc"]: r["component"] for r in icws.near_duplicates(documents(spark, rows)).collect()}
    hashes, sketch = WordHashes(), np.zeros(icws.SKETCH_ROWS << icws.SKETCH_BITS)
    sets = [np.unique(shingles(hashes.of(words(t.encode())), 5)) for _, t in rows]
    families = {int(s.min()): i for i, s in reversed(list(enumerate(sets)))}
    for i in families.values():
        for cells in icws._cells(sets[i]):
            np.add.at(sketch, cells, 1)
    idf = icws.Idf(sketch, len(families))
    weighted = [icws.weighted_set(t.encode(), hashes, idf) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))]
    links = [p for p in pairs if icws.weighted_jaccard(weighted[p[0]], weighted[p[1]]) >= icws.SIMILARITY]
    assert found == dict(enumerate(components_of(len(rows), links)))
    contents = made["icws-apart"].select("content").distinct().count()
    assert contents > 20 and made["icws-crossed"].count() < contents
    if block == 5:  # 20 contents in a meeting or a few more
        meetings = icws._meetings(made["icws-apart"]).groupBy("bucket", "i", "j").count()
        assert meetings.agg(F.max("count")).first()[0] < 40 and meetings.where("j > i").count() > 0


@pytest.mark.parametrize("weight", [0.15, 0.6])  # above and below THINNED
def test_pairs_of_frequent_shingles_reach_the_comparison(spark, weight):
    rng = random.Random(8)
    idf = icws.Idf(np.zeros(icws.SKETCH_ROWS << icws.SKETCH_BITS), 1)
    idf.weights = np.full_like(idf.weights, weight)
    rows = []
    for i in range(300):
        parts = prose(rng, 150).split()
        rows.append((2 * i, " ".join(parts)))
        for at in (20, 70, 120):  # 131 of 161 shingles stay
            parts[at] = "x" + prose(rng, 1)
        rows.append((2 * i + 1, " ".join(parts)))
    table = spark.createDataFrame(rows, "doc long, text string")
    signed = icws._signed(table, SimpleNamespace(value=idf), icws.BANDS, icws.ROWS)
    numbers = {icws._content(words(t.encode())): d for d, t in rows}
    number = spark.createDataFrame([(bytearray(c), d // 2, d % 2) for c, d in numbers.items()], "content binary, pair long, side long")
    signed = signed.join(number, "content")
    left, right = (
        signed.where(F.col("side") == i).drop("side", "content").withColumnsRenamed({c: f"{c}_{s}" for c in signed.columns if c != "pair"})
        for i, s in enumerate("ab")
    )
    least = int(np.ceil(icws.AGREEMENT * icws.BANDS * icws.ROWS))
    assert left.join(right, "pair").where(icws._may_be_near(least, icws.SIMILARITY)).count() >= 299


def test_rows_without_id_meet_their_own_text_only(spark):
    rng = random.Random(4)
    rows = [(None, prose(rng, 30)) for _ in range(60)] + [(None, "one text that comes three times in all")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string")
    plain = icws._plain(table, "doc_id", "text")
    members = icws._memberships(plain).select("doc", "mark", "content", "marked")
    met = plain.join(members, ["doc", "mark"]).collect()
    assert len(met) == len(rows) and sorted(r["marked"] for r in met) == [1] * 60 + [3] * 3
    assert icws.drop_near_duplicates(table).count() == 61


def test_consistent_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(1, 2**63, 400).astype(np.uint64))
    a, b = rng.random(len(keys)) + 0.05, rng.random(len(keys)) + 0.05
    both = icws.signatures(np.concatenate([keys, keys]), np.concatenate([a, b]), np.array([0, len(keys)]), 2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((both[0] == both[1]).mean() - want) < 0.04


def test_near_duplicates_defined_cases(spark, odd, empty):
    found = icws.near_duplicates(odd)
    assert found.agg(F.sum("rows")).first()[0] == odd.count()
    by = {(r["doc"], r["content"] is None): r for r in found.collect()}
    assert by[5, False]["component"] == by[6, False]["component"] == 5
    assert by[3, True]["kept"] and by[2, True]["kept"] and by[icws.LAST_ID, False]["kept"]
    stay = icws.drop_near_duplicates(odd)
    assert stay.columns == odd.columns
    ids = Counter(r["doc_id"] for r in stay.select("doc_id").collect())
    assert ids == Counter({1: 1, 2: 1, 3: 1, None: 2, 4: 1, 5: 1, 7: 1, 8: 1, 9: 1})
    assert icws.drop_near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    want = components_of(500, links)
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got.collect()} == {i: want[i] for i in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- personal data ---------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for m in regex.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in regex.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in regex.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = regex.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in regex.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(regex.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def pii_texts():
    rng = random.Random(4)
    pieces = [
        "a.b@c-d.example.org", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "00010.0.0.255", "4539 1488 0343 6467",
        "4539-1488-0343-6467", "4539148803436467", "45391488034364671", "+49 (30) 1234-5678", "+1 (", "++12345678901",
        "1234567890123456789012", "\U0001f600", "é", " ", "-", ".", "\n", "word", "+", "12", "a@b.co.", "DE89370400440532013000",
    ]
    return ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(400)]


def test_base_spans_match_plain_patterns(spark):
    texts = [*pii_texts(), "mail a@b.co " * 700]
    found = pii.find_pii(documents(spark, list(enumerate(texts)))).select("doc_id", pii.listed(F.col("pii.base")).alias("s"))
    got = {r["doc_id"]: r["s"] for r in found.collect()}
    want = {i: ",".join(f"{k}:{a}:{b}" for a, _, k, b in plain_spans(t)) for i, t in enumerate(texts)}
    assert got == want


def test_added_spans_need_checks_and_context(spark):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00 thanks",
        "IBAN DE88 3704 0044 0532 0130 00 thanks",
        "pay to GB82WEST12345698765432.",
        "her social security number is 219-09-9999, she said",
        "order 219-09-9999 came late",
        "phone 555-867-5309 any time",
        "call +1 555-867-5309 any time",
    ]
    found = pii.find_pii(documents(spark, list(enumerate(texts))))
    got = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["pii"]["all"]] for r in found.collect()}
    assert got == {
        0: [("iban", 5)],
        1: [],
        2: [("iban", 7)],
        3: [("ssn", 30)],
        4: [],
        5: [("local_phone", 6)],
        6: [("phone", 5)],
    }


def test_pii_defined_cases(spark, odd, empty):
    found = pii.find_pii(odd)
    assert found.count() == odd.count()
    assert found.columns == [*odd.columns, "pii"]
    assert found.where("text is null").selectExpr("max(size(pii.all))").first()[0] == 0
    assert pii.find_pii(empty).count() == 0


# --- token counts ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def library_counts(path, texts):
    from tokenizers import Tokenizer

    return [len(e) for e in Tokenizer.from_file(path).encode_batch(list(texts), add_special_tokens=False)]


def token_texts():
    rng = random.Random(9)
    pieces = ["word ", "  ", "\n\n", "don't ", "été", "中文字", "🙂", "12345", "<|endoftext|>", "...", " ", "\t", "ab" * 40, "é́", "x"]
    return ["".join(rng.choices(pieces, k=rng.randrange(0, 400))) for _ in range(60)]


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 512), (200, 16), (120, 60)])
def test_tokens_match_the_library(spark, vocabulary, chunk, overlap):
    texts = [*token_texts(), "a" * 3000, " " * 3000, "x <|endoftext|>" * 200, "中" * 1500]
    docs = documents(spark, [*enumerate(texts), (999, None), (5, texts[5])])
    got = token_counts.count_tokens(docs, vocabulary, chunk=chunk, overlap=overlap).select("doc_id", "n_tokens").collect()
    want = Counter([*enumerate(library_counts(vocabulary, texts)), (999, 0), (5, library_counts(vocabulary, [texts[5]])[0])])
    assert Counter(map(tuple, got)) == want


def test_quick_split_agrees_with_the_library_on_every_character(vocabulary):
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(vocabulary).pre_tokenizer
    for code in range(0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or token_counts._OTHER.search(c):
            continue
        for text in (f"a{c}1{c}{c} {c}. {c}", f"{c}  {c}s 's{c}'s"):
            places = [b for _, b in split.pre_tokenize_str(text)]
            assert [m.span() for m in token_counts.SPLIT.finditer(text)] == places, (code, text)


def test_token_counts_defined_cases(odd, empty, vocabulary):
    found = token_counts.count_tokens(odd, vocabulary, chunk=50_000)
    assert found.columns == [*odd.columns, "n_tokens"]
    rows = found.collect()
    assert len(rows) == odd.count()
    assert [r["n_tokens"] for r in rows] == library_counts(vocabulary, [r["text"] or "" for r in rows])
    assert token_counts.count_tokens(empty, vocabulary).count() == 0


# --- quality ---------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = pu_quality.train(docs, labels, usable=~held_out)
    scored = pu_quality.score(docs, model).where(held_out).join(labels, "doc_id").select("score", "quality").collect()
    right = np.mean([(r["score"] >= 0.5) == bool(r["quality"]) for r in scored])
    assert len(scored) > 50 and right >= 0.95
    again = pu_quality.train(docs.repartition(7), labels, usable=~held_out)
    assert np.array_equal(model.weights, again.weights) and model.prior == again.prior


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(1)
    for prior in (0.5, 0.9):
        good, bad = rng.normal(1, 1, 20_000), rng.normal(-4, 1, 20_000)
        mixed = np.where(rng.random(20_000) < prior, rng.normal(1, 1, 20_000), bad)
        assert abs(pu_quality.estimate_prior(good, mixed) - prior) < 0.05


def test_quality_defined_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, None), (None, 1)], "doc_id long, quality int")
    model = pu_quality.train(odd, labels)
    scored = pu_quality.score(odd.drop("score"), model)
    assert scored.count() == odd.count()
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    assert pu_quality.train(odd, labels.limit(0)) is None
    assert pu_quality.score(empty.drop("score"), model).count() == 0
    assert pu_quality.score(odd.drop("score"), None).where("score = 0.5").count() == odd.count()
    assert pu_quality.score(odd, model).columns == [*odd.drop("score").columns, "score"]


# --- mixing ----------------------------------------------------------------------------------------------------------


def shares_table(spark, shares):
    return spark.createDataFrame(list(shares.items()), "source string, shares long")


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 50, "b": 1, "c": 1, "d": 7, "e": 13}])
def test_period_keeps_release_deadline_and_lag(spark, shares):
    slots = pfair.period_slots(shares_table(spark, shares)).collect()
    period = sum(shares.values())
    assert sorted(r["slot"] for r in slots) == list(range(period))
    owner = {}
    for r in slots:
        w, j = shares[r["source"]], r["turn"]
        assert j * period // w <= r["slot"] < -(-(j + 1) * period // w)
        owner[r["slot"]] = r["source"]
    done = Counter()
    for t in range(period):
        done[owner[t]] += 1
        assert all(abs(done[s] - (t + 1) * w / period) < 1 for s, w in shares.items())


def test_mixture_deviates_by_less_than_a_block(spark):
    shares = {"a": 6, "b": 3, "c": 1}
    sizes = {"a": 600, "b": 310, "c": 120}
    rows = [(i, "t", s) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    mixed = pfair.mix_sources(documents(spark, rows), shares_table(spark, shares), block_rows=4)
    found = sorted((r["slot"], r["place"], r["source"], r["doc_id"], r["release"], r["deadline"]) for r in mixed.collect())
    assert len(found) == len(rows) == len({f[3] for f in found})
    assert all(release <= slot < deadline for slot, _, _, _, release, deadline in found)
    done, period = Counter(), 10
    for slot in range(240):  # until the first source runs out
        own = [f for f in found if f[0] == slot]
        assert len(own) == 4 and len({f[2] for f in own}) == 1
        done[own[0][2]] += 1
        assert all(abs(done[s] - (slot + 1) * w / period) < 1 for s, w in shares.items())


def test_mixing_defined_cases(spark, odd, empty):
    docs = odd.withColumnRenamed("score", "slot").withColumn("__order", F.lit(1))
    mixed = pfair.mix_sources(docs, pfair.sqrt_shares(docs))
    assert mixed.count() == docs.count()
    assert mixed.where("slot is null or block is null").count() == 0
    assert pfair.mix_sources(docs, shares_table(spark, {"a": 3})).count() == docs.count()
    none = empty
    assert pfair.mix_sources(none, pfair.sqrt_shares(none)).count() == 0


# --- line dedup ------------------------------------------------------------------------------------------------------


def test_recurring_passages_stay_once(spark):
    rng = random.Random(6)
    passage = prose(rng, 60)
    variants = [f"{passage[:200]} number {i} of {i * 7} {passage[200:]}" for i in range(4)]
    field = "the parcel left our house in {} on monday and will be with you in two days at most"
    own = [prose(rng, 40) for _ in range(12)]
    rows = [(i, own[i]) for i in range(12)]
    rows[2] = (2, f"{own[2]}\n{passage}\nAll rights reserved here.")
    rows[5] = (5, f"{passage}\n{own[5]}")
    for i in range(4):
        rows[6 + i] = (6 + i, f"{own[6 + i]}\n{variants[i]}\n{field.format(['rome', 'oslo', 'bonn', 'lima'][i])}")
    rows.append((20, own[0]))
    rows.append((21, own[1] + "\n" + prose(rng, 40)))
    found = line_templates.drop_recurring_lines(documents(spark, rows)).collect()
    got = {r["doc_id"]: (r["line_dedup"]["text"], r["line_dedup"]["kept"]) for r in found}
    want = dict(rows)
    want[5] = own[5]
    for i in range(1, 4):
        want[6 + i] = own[6 + i]
    assert {i: t for i, (t, _) in got.items() if i not in (20, 21)} == {i: t for i, t in want.items() if i not in (20, 21)}
    assert got[20] == ("", False)
    assert got[21][1] and own[1] not in got[21][0]
    assert all(kept for i, (_, kept) in got.items() if i != 20)


def test_short_lines_need_more_documents(spark):
    rows = [(i, f"{prose(random.Random(i), 30)}\nAll rights reserved.") for i in range(6)]
    few = line_templates.drop_recurring_lines(documents(spark, rows[:4])).where("line_dedup.n_dropped > 0").count()
    many = line_templates.drop_recurring_lines(documents(spark, rows)).where("line_dedup.n_dropped > 0").count()
    assert (few, many) == (0, 5)


def test_distinct_lines_stay(spark):
    rng = random.Random(3)
    cities = "rome oslo bonn lima cairo delhi paris quito".split()
    rows = [(i, f"Visit our shop {c}\nsome other text of document number {prose(rng, 1)}") for i, c in enumerate(cities)]
    rows += [(50 + i, " ".join(str(rng.randrange(10_000)) for _ in range(8)) + "\n" + prose(rng, 30)) for i in range(6)]
    rows += [(80 + i, "the first words of this line are " + prose(rng, 12)) for i in range(30)]
    found = line_templates.drop_recurring_lines(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["line_dedup"]["text"], r["line_dedup"]["n_dropped"]) for r in found} == {d: (t, 0) for d, t in rows}


def plain_templates(rows):
    """{doc: masked lines that go}, from the rules as the module states them."""
    L = line_templates
    lines = [(d, line) for d, text in rows for line in plain_masked(text)]
    index = {(d, line) for d, line in lines if counts(line.split(" "))}
    leaves = defaultdict(set)
    for _, line in index:
        tokens = line.split(" ")
        if len(tokens) - L.DEPTH >= L.CONSTANT:
            leaves[len(tokens), tuple(tokens[: L.DEPTH])].add(line)
    wide = {}
    for leaf, members in leaves.items():
        if len(members) < 2:
            continue
        cells = {m: plain_cells(m.split(" ")[L.DEPTH :]) for m in members}
        tops = []
        for column in zip(*cells.values(), strict=True):
            value, n = Counter(column).most_common(1)[0]
            tops.append(value if value and 2 * n > len(column) else None)
        for m, own in cells.items():
            agreed = sum(a == b for a, b in zip(own, tops, strict=True) if b)
            if agreed >= max(L.CONSTANT, L.SIMILARITY * len(own)):
                wide[m] = leaf
    kinds = [((line, False), d, line) for d, line in index] + [((wide[m], True), d, m) for d, m in index if m in wide]
    holders, longest = defaultdict(set), Counter()
    for kind, d, line in kinds:
        holders[kind].add(d)
        longest[kind] = max(longest[kind], len(line.split(" ")))
    gone = defaultdict(set)
    for kind, d, line in kinds:
        need = (L.MIN_DOCS if longest[kind] >= L.LONG_TOKENS else L.SHORT_DOCS) * (L.WIDE_TIMES if kind[1] else 1)
        if len(holders[kind]) >= need and d != min(holders[kind]):
            gone[d].add(line)
    return gone


def plain_masked(text):
    even = [" ".join(regex.findall(r"[^ \t\r]+", line)) for line in text.split("\n")]
    return [" ".join("<*>" if regex.search("[0-9]", t) else t for t in line.split(" ")) for line in even]


def plain_cells(tokens):
    n = len(tokens)
    k = min(n, line_templates.CELLS)
    return [" ".join(t for t in tokens[c * n // k : (c + 1) * n // k] if t != "<*>") for c in range(k)]


def counts(tokens):
    fields = tokens.count("<*>")
    return len(tokens) - fields >= line_templates.MIN_TOKENS and len(tokens) - fields > fields


def test_line_templates_match_brute_force(spark):
    rng = random.Random(21)
    shapes = ["a b c {} d e f", "a b c x {} y z w v", "one two three {} {} four five six seven", "k l {} m", "p q r s t u v w x y z {} {} b c d e f g h i j"]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            shape = rng.choice(shapes)
            lines.append(shape.format(*[rng.choice(["n1", "77", "red", "blue", "x"]) for _ in range(shape.count("{"))]))
            if rng.random() < 0.3:
                lines.append(prose(rng, rng.randrange(1, 12)))
        rows.append((d, "\n".join(lines)))
    gone = plain_templates(rows)
    found = line_templates.drop_recurring_lines(documents(spark, rows)).collect()
    got = {r["doc_id"]: r["line_dedup"]["text"] for r in found}
    want = {
        d: "\n".join(line for line, m in zip(text.split("\n"), plain_masked(text), strict=True) if m not in gone[d])
        for d, text in rows
    }
    assert got == want and sum(map(len, gone.values())) > 20


def test_line_dedup_defined_cases(spark, odd, empty):
    found = line_templates.drop_recurring_lines(odd)
    assert found.columns == [*odd.columns, "line_dedup"]
    assert found.count() == odd.count()
    assert found.where("text is null and (line_dedup.n_lines <> 0 or not line_dedup.kept)").count() == 0
    # both rows of id 1 are one document, so nothing of it recurs
    assert found.where("doc_id = 1 and line_dedup.n_dropped > 0").count() == 0
    assert line_templates.drop_recurring_lines(empty).count() == 0


def test_lines_are_parsed_once(spark):
    """A filter on parsed values would be pushed below the projection and parse every line a second time."""
    docs = spark.createDataFrame([(1, "a b c d e\n1 2 3 x y")], "doc_id long, text string")
    plan = line_templates._line_index(docs, "doc_id", "text", 3, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("named_struct(") == 1 and not [x for x in plan.splitlines() if "Filter" in x and "named_struct(" in x]
