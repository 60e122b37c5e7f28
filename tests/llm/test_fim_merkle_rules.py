"""Fill-in-the-middle, Merkle manifest and line rules against plain restatements, and their defined cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from llm_fixtures import documents, odd_documents, prose
from pyspark.sql import functions as F

from retailweave.llm import fim, line_rules, merkle


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


# --- fill-in-the-middle ---------------------------------------------------------------------------------------------


def plain_fim(doc, text, seed=42):
    text = text or ""
    ends = [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    n, places = len(ends), [0, *ends]
    digest = sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((places[h[0] % (n + 1)], places[h[1] % (n + 1)]))
    if h[3] % 100 < 80:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fim_matches_a_walk_over_the_units(spark):
    rng = random.Random(5)
    signs = ["a", "Bc", " ", "  ", "\n", "\t\x0b\r", "é", " ", "\x1c", "<", "<S", "S>", "\U0001f600", "<P", ">"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(500, "a <P> b"), (501, "<M>"), (None, "one two three"), (3, rows[3][1])]
    cut = fim.fill_in_middle(documents(spark, rows))
    cut = cut.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert Counter((r["doc_id"], *r["fim"]) for r in cut) == Counter((d, *plain_fim(d, t)) for d, t in rows)
    assert all(r["back"] == r["text"] for r in cut)
    assert {r["fim"]["form"] for r in cut} == {"plain", "psm", "spm"}


def test_fim_rates_and_sentinels(spark):
    docs = documents(spark, [(i, "one two three four") for i in range(300)])
    marks = fim.Sentinels("<|pre|>", "<|suf|>", "<|mid|>")
    cut = fim.fill_in_middle(docs, rate=100, spm_rate=0, sentinels=marks)
    assert {r[0] for r in cut.select("fim.form").distinct().collect()} == {"psm"}
    back = fim.restored(F.col("fim.output"), F.col("fim.form"), marks)
    assert cut.where(back != F.col("text")).count() == 0
    assert fim.fill_in_middle(docs, rate=0).where("fim.form <> 'plain' OR fim.output <> text").count() == 0
    for wrong in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            fim.Sentinels(*wrong)


def test_fim_defined_cases(spark, odd):
    clash = odd.withColumn("fim", F.lit(1)).withColumn("__draws", F.lit(2))
    cut = fim.fill_in_middle(clash)
    assert cut.columns == [c for c in clash.columns if c != "fim"] + ["fim"]
    rows = cut.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert tuple(r["fim"]) == plain_fim(r["doc_id"], r["text"])
    assert fim.fill_in_middle(clash.limit(0)).count() == 0


# --- Merkle manifest ------------------------------------------------------------------------------------------------

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def hexed(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in COLUMNS)))


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hexed("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 8 * 8
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 8])))
        i //= 8
    return out


def plain_manifest(rows, claimed):
    """Counter of (leaf, subroot, root, proof_sha256, folded_root) of all rows."""
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, plain_leaf(row), claimed(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_levels([x[2] for x in sorted(groups[g])]) for g in names]
    top = plain_levels([t[-1][0] for t in trees])
    found = Counter()
    for place, (name, tree) in enumerate(zip(names, trees, strict=True)):
        for i, (_, _, leaf, other) in enumerate(sorted(groups[name])):
            path = plain_path(tree, i) + plain_path(top, place)
            folded = other
            for before, after in path:
                folded = hexed(before + folded + after)
            found[leaf, tree[-1][0], top[-1][0], hexed("".join(b + a for b, a in path)), folded] += 1
    return found


def got_manifest(docs, claimed, **options):
    manifest = merkle.build_manifest(docs.withColumn("claimed", claimed), COLUMNS, keep=["claimed"], **options)
    return merkle.prove(manifest, "claimed").collect()


def test_slots_are_van_emde_boas_order():
    for levels in range(1, 6):
        rows = [merkle.slots(levels, d, np.arange(8**d)) for d in range(levels)]
        assert sorted(np.concatenate(rows).tolist()) == list(range(merkle.tree_size(levels)))
    # five rows: two rows on top, then sixty-four subtrees of three rows, each in one piece and laid out alike
    size = merkle.tree_size(3)
    for tree in (0, 1, 63):
        below = [merkle.slots(5, 2 + d, tree * 8**d + np.arange(8**d)) for d in range(3)]
        alike = [merkle.slots(3, d, np.arange(8**d)) for d in range(3)]
        start = merkle.tree_size(2) + tree * size
        assert all((b - start == a).all() for b, a in zip(below, alike, strict=True))


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_matches_plain_trees(spark, height):
    rng = random.Random(9)
    sizes = {None: 3, "de": 1, "en": 150, "fr": 64, "é": 65, "a": 8, "b": 9, "c": 2, "d": 1, "z": 1}
    rows, doc = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            doc += 1
            text = rng.choice([None, "", "Été A", prose(rng, 5).title()])
            rows.append((doc * 7919 % 100_003, text, lang, rng.choice([None, "s"]), rng.choice([None, 5])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    low = "".join(chr(c) for c in range(97, 123))
    other = merkle.leaf_digest([F.translate("text", low.upper(), low) if c == "text" else F.col(c) for c in COLUMNS])

    def lowered(row):
        text = row["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
        return plain_leaf({**row.asDict(), "text": text})

    got = got_manifest(docs, other, height=height)
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    assert Counter(tuple(r[c] for c in names) for r in got) == plain_manifest(docs.collect(), lowered)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    assert any(r["verified"] for r in got) and not all(r["verified"] for r in got)


def test_paths_lead_to_the_root(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(100)])
    manifest = merkle.build_manifest(docs, COLUMNS, height=1)
    proofs = merkle.prove(manifest, keep_path=True).collect()
    assert len(proofs) == 100 and all(r["verified"] for r in proofs)
    for r in proofs:
        node = r["leaf"]
        for step in r["path"]:
            node = hexed(step["before"] + node + step["after"])
        assert node == manifest.root
    with pytest.raises(ValueError):
        merkle.build_manifest(docs, COLUMNS, keep=["Leaf"])


def test_manifest_defined_cases(spark, odd):
    same = merkle.leaf_digest([F.col(c) for c in COLUMNS])
    got = got_manifest(odd, same)
    assert Counter(tuple(r[c] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")) for r in got) == plain_manifest(
        odd.collect(), plain_leaf
    )
    assert all(r["verified"] for r in got)
    manifest = merkle.build_manifest(odd.limit(0), COLUMNS)
    assert manifest.root is None and merkle.prove(manifest).count() == 0
    alone = documents(spark, [(7, "alone")])
    manifest = merkle.build_manifest(alone, COLUMNS)
    proof = merkle.prove(manifest).collect()[0]
    assert manifest.root == proof["leaf"] == proof["subroot"] and proof["proof_sha256"] == hexed("")


# --- line rules -----------------------------------------------------------------------------------------------------


def plain_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    inside = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def even(line):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in line)
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", lowered))


def plain_rules(rows, min_docs, share):
    """[(doc, figures, base_failed, common lines, words left, kept, text without them)] of rows (doc, text, host)."""
    texts, held = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if even(line):
                held[host, even(line)].add(text or "")
    out = []
    for doc, text, host in rows:
        figures = plain_figures(text or "")
        common = [
            len(held.get((host, even(line)), ())) >= min_docs and len(held[host, even(line)]) > len(texts[host]) * share
            for line in (text or "").split("\n")
        ]
        lines = (text or "").split("\n")
        left = figures[0] - sum(len(even(line).split(" ")) for line, c in zip(lines, common, strict=True) if c)
        failed = figures[0] < 50 or 100 * figures[4] > 50 * figures[0]
        stay = text if text is None else "\n".join(line for line, c in zip(lines, common, strict=True) if not c)
        out.append((doc, figures, failed, sum(common), left, not failed and left >= 0.5 * figures[0], stay))
    return out


def rule_rows():
    rng = random.Random(12)
    menu = [prose(rng, 9), "Call 0800 123 now", "é ü \t ç"]
    rows = []
    for i in range(120):
        host = rng.choice(["hot", "hot", "hot", "b", None])
        lines = [prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(4)):
            line = rng.choice([*menu, "", "  ", "a b a b a b a b", "Call 0900 777  now", menu[0].upper()])
            lines.insert(rng.randrange(len(lines) + 1), line)
        if i % 9 == 0:
            lines = [menu[0]] * 1 + [menu[1]] * 1 + [prose(rng, 4)] + [menu[0].upper()] * 6
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n", " # $ <b>"]), host))
    return rows + [(200 + i, rows[4][1], rows[4][2]) for i in range(40)] + [(300, None, "b"), (301, "", None), (302, " \n ", "hot")]


@pytest.mark.parametrize("min_docs,share", [(3, 0.1), (10, 0.01), (2, 0.5)])
def test_line_rules_match_brute_force(spark, min_docs, share):
    rows = rule_rows()
    judged = line_rules.judge(documents(spark, rows).repartition(4), min_docs=min_docs, share=share, cleaned=True).collect()
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter(
        (r["doc_id"], tuple(r["rules"][c] for c in figures), *(r["rules"][c] for c in ("base_failed", "n_common_lines", "left_words", "kept")), r["text"])
        for r in judged
    )
    assert got == Counter(plain_rules(rows, min_docs, share))


def test_depleted_documents_go_and_copies_stay(spark):
    rng = random.Random(4)
    menu = prose(rng, 40)
    rows = [(i, f"{menu}\n{prose(rng, 60)}", "h") for i in range(50)]
    rows += [(100 + i, f"{menu}\n{prose(rng, 15)}", "h") for i in range(5)]
    rows += [(200 + i, prose(random.Random(1), 80), "h") for i in range(30)]  # one document, thirty rows
    rows += [(300, f"{menu}\n{prose(rng, 15)}", "other")]
    judged = {r["doc_id"]: r["rules"] for r in line_rules.judge(documents(spark, rows)).collect()}
    assert {d for d, r in judged.items() if not r["kept"]} == {100, 101, 102, 103, 104}
    assert judged[0]["left_words"] == 60 and judged[200]["n_common_lines"] == judged[300]["n_common_lines"] == 0


def test_repeated_words_of_long_texts():
    rng = random.Random(8)
    for size, known in ((3, 2), (4, 2), (200, 3), (3_000, 12), (50_000, 40)):
        words = [rng.choice([f"w{i}" for i in range(known)]) for _ in range(size)]
        assert line_rules.repeated_words([w.encode() for w in words]) == plain_figures(" ".join(words))[4]


def test_line_rules_defined_cases(spark, odd):
    clash = odd.withColumn("rules", F.lit("x")).withColumn("__row", F.lit(1)).withColumn("line", F.lit(1))
    judged = line_rules.judge(clash)
    assert judged.columns == [c for c in clash.columns if c not in ("rules", "text")] + ["rules"]
    rows = judged.collect()
    assert len(rows) == odd.count()
    assert all(r["rules"]["base_failed"] and not r["rules"]["kept"] for r in rows if r["doc_id"] in (2, 3))
    assert line_rules.judge(clash.limit(0)).count() == 0
