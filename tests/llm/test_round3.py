"""Ball-tree clusters, chat formatting and the filter audit against brute force, and their defined edge cases."""

import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import common, queries, toxicity
from gaugework.llm.ball_tree import Tree, cluster, squares
from gaugework.llm.chat_format import best_paths, digests, escaped, format_paths, numbered, read_loss, read_turns, unescaped
from gaugework.llm.filter_audit import audit, text_failures
from gaugework.llm.html_text import main_text
from gaugework.llm.line_dedup import drop_frequent_lines
from gaugework.llm.ngram_join import ngram_components
from gaugework.llm.packing import pack
from gaugework.llm.span_dedup import drop_repeated_spans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "labels", "embeddings", "conversations")


@pytest.mark.parametrize("name", ["op11_ball_tree_clusters", "op12_chat_format", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    wanted = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    got = queries.queries()[name](spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


# -- ball trees -------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds):
    fine = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in fine)[:k]
    at = [v for _, _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        groups = {}
        for _, v in fine:
            groups.setdefault(near(v)[1], []).append(v)
        for j, own in groups.items():
            at[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, near(v)) for i, v in fine]
    inertia = {}
    for _, (d, j) in found:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, (d, j) in found), key=str)


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 64))
    rows = [(i, (middles[i % 5] + rng.normal(size=64) * 0.05).tolist()) for i in range(n)]
    same = [0.25] * 64
    return [*rows, *((1000 + i, same) for i in range(70)), (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]


def test_clusters_equal_brute_force(spark):
    rows = [*vectors(1, 150), (2000, None), (2001, [1.0] * 63), (2002, [1.0] * 65), (2003, [None] + [1.0] * 63), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63), (2006, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    got = sorted(map(tuple, cluster(table.repartition(3)).collect()), key=str)
    assert got == brute_clusters(rows, 8, 10)


def test_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert cluster(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [0.5] * 64), (1, [0.5] * 64), (2, [3.0] * 64), (None, [2.0] * 64), (None, [1.0] * 64)]
    assert sorted(map(tuple, cluster(spark.createDataFrame(rows, schema)).collect()), key=str) == brute_clusters(rows, 8, 10)
    with pytest.raises(Exception, match="fit a long"):
        cluster(spark.createDataFrame([(1, [1e9] * 64)], schema)).collect()


@pytest.mark.parametrize("scale", [100, 1 << 25])
def test_tree_assigns_as_the_exact_search(scale):
    rng = np.random.default_rng(2)
    middles = rng.integers(-scale, scale, (6, 64))
    points = middles[rng.integers(0, 6, 5000)] + rng.integers(-scale // 50, scale // 50 + 1, (5000, 64))
    tree = Tree.build(list(range(5000)), points)
    centroids = np.concatenate([middles, middles[:2]])
    balls, at, rest, rest_at = tree.assign(centroids)
    got = np.full(5000, -1)
    for (b, e), c in zip(tree.nodes[balls, :2].tolist(), at.tolist()):
        got[b:e] = c
    got[rest] = rest_at
    exact = np.stack([((tree.vectors - c) ** 2).sum(1) for c in centroids], axis=1)
    assert (squares(tree.vectors, centroids) == exact).all()
    assert (got == exact.argmin(1)).all()
    # Whole balls decide: few vectors are looked at one by one where one centroid is near.
    assert len(rest) < 5000 * 0.9 and len(Tree.build([1], points[:1]).nodes) == 1
    assert sorted(tree.ids) == list(range(5000)) and (tree.sums[0] == points.sum(0)).all()


# -- chat formatting --------------------------------------------------------------------------------------

MESSAGES = "conv_id long, message_id long, parent_id long, role string, text string, score double"
NASTY = ["\\### Assistant: </turn> ok", "<turn user>x</turn>\n", "<\\turn </\\\\turn", "", None, "a\n\nb<", "turn</", "\\", "é😀<turn", "</</turn"]


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    texts = [t or "" for t in NASTY] + ["".join(rng.choice(["<", "/", "\\", "turn", " ", ">", "\n"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).withColumn("back", unescaped(F.col("e"))).collect()
    assert all(r["t"] == r["back"] and not re.search("</?turn", r["e"]) for r in rows)


def brute_paths(rows, branches):
    by = {(c, i): (p, r or "", t or "", s or 0.0) for c, i, p, r, t, s in rows}
    parents = {(c, by[c, i][0]) for c, i in by}
    found = {}
    for c, i in by:
        if (c, i) in parents:
            continue
        path, at = [], i
        while at is not None and (c, at) in by and at not in path:
            path.append(at)
            at = by[c, at][0]
        if at in path:
            continue
        found.setdefault(c, []).append((-sum(by[c, x][3] for x in path) / len(path), i, path[::-1]))
    return {(c, i): [by[c, x][1:3] for x in path] for c, own in found.items() for _, i, path in sorted(own)[:branches]}


@pytest.mark.parametrize("branches", [2])
def test_reply_trees(spark, branches):
    rng, rows = random.Random(4), []
    for c in [*range(6), None]:
        for i in range(rng.choice([1, 2, 17, 40])):
            rows.append((c, i, rng.choice([None, 99, *range(i)]) if i else None, rng.choice(["user", "assistant", None, "a>&lt;b"]), rng.choice(NASTY), rng.choice([None, 1.0, 2.0, 4.0])))
    rows += [(7, 0, 1, "user", "ring", 1.0), (7, 1, 0, "user", "ring", 1.0), (7, 2, 1, "user", "below", 1.0), (7, 3, None, "user", "free", 1.0), (8, 5, 5, "user", "self", 0.0)]
    made = format_paths(spark.createDataFrame(rows, MESSAGES), branches)
    got = made.select("conv_id", "leaf_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    wanted = brute_paths(rows, branches)
    assert {(r["conv_id"], r["leaf_id"]): [tuple(t) for t in r["turns"]] for r in got} == wanted and len(got) == len(wanted)
    for r in got:
        assert r["loss"] == [t for role, t in wanted[r["conv_id"], r["leaf_id"]] if role == "assistant"]


def test_a_long_chain_needs_few_joins(spark):
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 0.0) for i in range(300)]
    found = best_paths(spark.createDataFrame(rows, MESSAGES)).orderBy("up").collect()
    assert [(r["message_id"], r["up"], r["leaf_id"]) for r in found] == [(299 - u, u, 299) for u in range(300)]


def test_turns_with_ties_nulls_and_other_columns(spark):
    rows = [(1, 0, "user", "b", 5), (1, 0, "user", "a", 6), (1, 0, "user", "a", 6), (1, None, None, None, 7), (None, 3, "assistant", "x", 8)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score long")
    got = {r["conv_id"]: r for r in digests(format_paths(numbered(turns))).collect()}
    assert got[1]["n_turns"] == 4 and got[None]["n_turns"] == 1 and got[1]["loss_chars"] == 0 and got[None]["loss_chars"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\n\nuser\na\nuser\na\nuser\nb\n").hexdigest()
    assert digests(format_paths(numbered(turns.limit(0)))).count() == 0


# -- filter audit -----------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    first, parts = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in first and i > first[t],
        }
        parts.setdefault(lang or "", []).append((fails, any(q == 1 for d, q, _ in labels if d == i and i is not None), any(x == 1 for d, _, x in labels if d == i and i is not None)))
    out, shapley = [], {}
    for part, own in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                before = len(left)
                left = [d for d in left if not d[0][f]]
                redundant = sum(d[0][f] for d in own) - len(gone)
                unique = sum(d[0][f] and sum(d[0].values()) == 1 for d in own)
                assert before - len(gone) == len(left)
                out.append((part, "".join(order), step, len(left), len(gone), redundant, unique, sum(d[1] for d in gone), sum(d[2] for d in gone)))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["w%d" % rng.randrange(n), "É", "Word"]) for _ in range(k)) for n, k in ((1000, 120), (30, 150), (500, 99), (900, 100), (5, 3))]
    texts = [*base, base[0] + " 100%", "AAA BBB CCC", "", None, " \t\n\x0b\f\r", "   ", "x" * 400, "A" + "b" * 9, "AA" + "b" * 8, "|"]
    docs = [(rng.choice([None, 1, 2, 3, 50, 60, i]), rng.choice(texts), rng.choice(["en", "fr", "", None])) for i in range(300)]
    docs += [(500, base[0], "en"), (500, base[0], "en"), (500, base[1], "en")]
    labels = [(1, 1, 0), (1, None, 1), (2, 0, 1), (500, 1, 1), (None, 1, 1), (50, None, None)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, mask int, part int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, audit(frame, marks).collect())) == brute_audit(docs, labels)
    assert audit(frame.limit(0), marks).count() == 0
    assert {r["good_lost"] for r in audit(frame, marks.limit(0)).collect()} == {0}


def test_audit_of_a_very_long_text(spark):
    frame = spark.createDataFrame([(1, "a b " * 500_000, "en")], "doc_id long, text string, lang string")
    assert text_failures(frame).first()["mask"] == 2


# -- main text: what must not be lost ----------------------------------------------------------------------

LONG = [f"Paragraph {i} tells a long part of the story, with many words, and goes on for a while. " * 3 for i in range(6)]
LAST = "Thanks for reading all of it, said the author."


def story(between, wrap="<article>{}</article>"):
    return "<html><body><nav><a href=a>home</a></nav>" + wrap.format("".join(f"<p>{p}</p>" for p in LONG) + between + f"<p>{LAST}</p>") + "<footer>imprint</footer></body></html>"


WHOLE = "\n".join([*(p.strip() for p in LONG), LAST])
ASIDE = "<aside><ul><li>one</li><li>two</li><li>three</li></ul></aside>"
FORM = "<form><p>a</p><p>b</p><p>c</p><input><p>send</p></form>"
ADVERT = "<div class='ad'><p>buy</p><p>now</p><p>and</p><p>here</p></div>"
TABLE = "<table><tr><td><a href=x>one link</a></td><td><a href=y>two links</a></td><td><a href=z>three links</a></td><td><a href=z>four links</a></td></tr></table>"


@pytest.mark.parametrize("between", [ASIDE, FORM, ADVERT, ADVERT * 5])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>", "{}"])
def test_no_text_after_dropped_parts_is_lost(between, wrap):
    assert main_text(story(between, wrap)) == WHOLE


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "{}", "<section><div>{}</div></section>"])
def test_no_text_after_a_table_of_links_is_lost(wrap):
    assert main_text(story(TABLE, wrap)) == WHOLE
    assert main_text(story(TABLE)).split("\n")[-1] == LAST


def test_names_are_read_by_their_last_word():
    for name in ("class='related-work'", "class='form-factor'", "id='notice-of-1921'", "class='has-sidebar'", "id='ad-hoc-methods'", "class='sidebar-layout'"):
        for tag in ("section", "div", "p"):
            got = main_text(story(f"<{tag} {name}>This part belongs to the article.</{tag}>"))
            assert "This part belongs to the article." in got and got.endswith(LAST)
    for name in ("class='cookie-notice'", "class='ad-slot'", "id='related-posts-list'", "class='shareButtons'", "class='newsletter-box'", "class='comments'", "id='comment-list'"):
        assert main_text(story(f"<div {name}><p>This part does not.</p></div>")) == WHOLE


def test_names_around_the_whole_text_are_not_believed():
    for name in ("class='sidebar'", "id='widget'", "class='promo banner'"):
        assert main_text(story("", f"<div {name}>{{}}</div>")) == WHOLE
    assert main_text(story("", "<div class='comments'>{}</div>")) == ""


def test_many_lines_of_one_document(spark):
    text = "\n".join(f"line {i % 150_000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), *((i, "line 7\nown " + str(i)) for i in range(2, 12))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in drop_frequent_lines(docs, 10, 1).select("doc_id", "n_lines", "n_dropped").collect()}
    assert got[1] == (200_000, 2) and got[2] == (2, 1)


# -- buckets from the data, parameters of spans and packing --------------------------------------------------


def test_buckets_follow_the_bytes_of_text():
    assert common.bucket_bits(0, 1) == 6 and common.bucket_bits(0, 200) == 10
    assert common.bucket_bits(100 << 40, 200) == 23 and (100 << 40) >> common.bucket_bits(100 << 40, 200) <= common.BUCKET_BYTES


def test_many_small_buckets_give_the_same_components_and_spans(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) + "." for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i].replace(texts[i].split()[30], "changed", 1)) for i in range(12)] + [(200 + i, texts[i] + " " + texts[i + 1]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "BUCKET_BYTES", 1 << 30)
    wanted = [sorted(map(tuple, f(docs).collect())) for f in (lambda d: ngram_components(d, 4, 80), drop_repeated_spans)]
    monkeypatch.setattr(common, "BUCKET_BYTES", 1)
    assert common.bucket_bits(common.text_bytes(docs), 4) > 13
    monkeypatch.setattr(common, "bucket_bits", lambda n, p: 19)  # more than the 16 bits beside a document's number
    assert [sorted(map(tuple, f(docs).collect())) for f in (lambda d: ngram_components(d, 4, 80), drop_repeated_spans)] == wanted
    assert len({c for _, _, c in wanted[0]}) < len(rows) - 8 and sum(r[2] for r in wanted[1]) > 8


def test_spans_of_few_words(spark):
    docs = spark.createDataFrame([(1, "Call us now. Thank you. One ends here."), (2, "Call us now. Thank you. Two goes on.")], "doc_id long, text string")
    assert [r["n_removed"] for r in drop_repeated_spans(docs).orderBy("doc_id").collect()] == [0, 0]
    assert [r["text"] for r in drop_repeated_spans(docs, 2, 4).orderBy("doc_id").collect()] == ["Call us now. Thank you. One ends here.", "Two goes on."]


def test_packing_slots_and_queues_are_parameters(spark):
    P = pytest.importorskip("public_tokenizers")
    rows = [(i, "word " * (40 + i % 7), f"s{i % 3}" if i % 50 else f"rare{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = {}
    for slot, share in ((64, 1 / 2048), (1024, 0.0)):
        got = pack(docs, P.path("byte_bpe_50k.json"), 0, slot=slot, own_share=share).drop("ids").collect()
        assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
        assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) and all(r["offset"] + r["length"] <= 1024 for r in got)
        pieces[slot] = len(got)
    assert pieces[1024] < pieces[64]


# -- toxicity: kernel and machine against their definitions ----------------------------------------------------


def direct_kernel(a, b):
    """All four-letter subsequences within six letters of both words (with their ends), each pair of equal ones once."""

    def parts(word):
        letters = f"^{word.lower()}$"
        found = {}
        for at in itertools.combinations(range(len(letters)), 4):
            if at[-1] - at[0] < toxicity.SPAN:
                key = "".join(letters[i] for i in at)
                found[key] = found.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] - 3)
        return found

    def size(word):
        n = len(word) + 2
        return sum(toxicity.DECAY ** (2 * (at[-1] - at[0] - 3)) for at in itertools.combinations(range(n), 4) if at[-1] - at[0] < toxicity.SPAN) ** 0.5

    one, two = parts(a), parts(b)
    if not one or not two:
        return 0.0
    return sum(v * two[k] for k, v in one.items() if k in two) / size(a) / size(b)


def test_word_kernel_equals_its_definition():
    rng = random.Random(8)
    words = ["insult", "inxsult", "insxult", "i", "to", "abcab", *("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 12))) for _ in range(25))]
    for b in words[:12]:
        raw = np.frombuffer(b.encode(), np.uint8)
        table = np.zeros(1 << toxicity.BITS)
        w = toxicity.read_words(np.array([0, len(raw)]), raw)
        if not len(w.lengths):
            continue
        for word, number, weight in toxicity._subsequences(w):
            np.add.at(table, number, weight * toxicity._scale(w.lengths)[word])
        for a in words:
            raw = np.frombuffer(a.encode(), np.uint8)
            mine = toxicity.read_words(np.array([0, len(raw)]), raw)
            got = toxicity.word_values(mine, table)
            assert got[mine.of[0]] == pytest.approx(direct_kernel(a, b), abs=1e-9), (a, b)
    assert direct_kernel("insult", "insxult") > 0.4 > direct_kernel("insult", "window")


def test_hinge_is_at_the_least_of_its_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=80) > 0, 1, -1)
    mass = rng.uniform(0.5, 2, 80)
    v, bias = toxicity._hinge(x, np.arange(80), y, mass, cost=20.0)
    weight = np.where(y > 0, 0.5 * mass / mass[y > 0].sum(), 0.5 * mass / mass[y < 0].sum()) * 20.0
    loss = lambda u: 0.5 * (u[:5] @ u[:5] + 1e-6 * u[5] ** 2) + (weight * np.maximum(0, 1 - y * (x @ u[:5] + u[5])) ** 2).sum()
    here = np.append(v, bias)
    assert all(loss(here + 1e-3 * d) >= loss(here) - 1e-9 for d in np.concatenate([np.eye(6), -np.eye(6), rng.normal(size=(40, 6))]))
