"""The corpus operators against brute force, and their defined edge cases, on small tables."""

import hashlib
import pickle
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugework.llm import common, encoding, exact_dedup, packing, toxicity
from gaugework.llm.decontaminate import contaminated_pairs, keep_uncontaminated
from gaugework.llm.exact_dedup import build_index, directory, exact_groups, extend_index, groups_of, keep_one_of_equals
from gaugework.llm.html_text import extract_pages, main_text, page_lines
from gaugework.llm.line_dedup import Runs, _sorted_scans, drop_frequent_lines
from gaugework.llm.ngram_join import keep_one_per_component, links, ngram_components
from gaugework.llm.packing import pack
from gaugework.llm.span_dedup import drop_repeated_spans, sentences
from gaugework.llm.token_counts import token_counts
from gaugework.llm.token_files import TokenFile, read_documents, write_token_files

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=SCHEMA):
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in ((*r, "src0")[:3] if len(r) < 3 else r for r in rows)]
    return spark.createDataFrame(full, schema)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=5, n=60):
    """Texts with copies, near copies, short and empty ones."""
    rng, out = random.Random(seed), []
    for i in range(n):
        base = words(rng, rng.choice([0, 1, 3, 4, 5, 40, 200]), 5000)
        out.append(base)
        if i % 4 == 0 and base:
            out.append(base)
        if i % 3 == 0 and len(base) > 100:
            edited = base.split()
            for _ in range(rng.choice([1, 2, 8])):
                edited[rng.randrange(len(edited))] = "changed"
            out.append(" ".join(edited))
            out.append(" ".join(edited[3:]))
    rows = [(i * 7 % 1009, t) for i, t in enumerate(out)]
    return [*rows, (2001, None), (2002, ""), (2003, "   \t\n"), (2004, "A b C d"), (2005, "a B c D")]


# -- n-gram join ------------------------------------------------------------------------------------------


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 5), (5, 80, 6), (2, 50, 7)])
def test_ngram_components_equal_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    got = {r[0]: (r[1], r[2]) for r in ngram_components(table(spark, rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_ngram_edges(spark):
    assert ngram_components(table(spark, []), 4, 85).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (3, "a b c d e f")]
    got = sorted(map(tuple, ngram_components(table(spark, rows), 4, 85).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (3, 3, 1), (None, 0, None)], key=str)
    kept = keep_one_per_component(table(spark, rows), 4, 85)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 1]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize(("k", "percent", "n_words"), [(5, 80, 100), (4, 85, 150)])
def test_ngram_edges_grow_with_the_group(spark, k, percent, n_words):
    rng = random.Random(21)
    base, rows = words(rng, n_words, 100_000).split(), []
    for i in range(200):
        edited = list(base)
        for _ in range(rng.randint(1, 2)):
            edited[rng.randrange(n_words)] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(edited)))
    for n in (100, 200):
        _, edges = links(table(spark, rows[:n]), k, percent)
        assert edges.count() <= 1.1 * n
    got = {r[0]: (r[1], r[2]) for r in ngram_components(table(spark, rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


# -- html -------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy now</div><aside>side</aside><div id="cookie-notice">ok?</div>
<article><h1>Head &amp; line</h1><p><b>One   two&nbsp;three<br><p>x.<p>caf&eacute; &lt;b&gt; &#8364;</p><form><input>send</form>
<div class="comments"><p>first!</p></div><p>last</p></article><footer>&copy; me</footer></body></html>"""


def test_html_main_text():
    assert main_text(PAGE) == "Head & line\nOne two three\nx.\ncafé <b> €\nlast"
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    assert main_text("<article>a<!-- b") == "a"
    assert main_text("<article>a<script>b") == "a"
    assert main_text("<article><p>" + "long words here " * 20_000) == ("long words here " * 20_000).strip()


def test_html_without_article_by_density():
    body = "".join(f"<p>{'A sentence of the story goes on here. ' * 4}</p>" for _ in range(4))
    html = f"<div><a href=x>home</a><a href=y>news</a></div>{body}<div><a href=z>legal</a></div>"
    assert main_text(html).count("\n") == 3 and "home" not in main_text(html) and "legal" not in main_text(html)


def slow_main_text(html, window=3, surge=0.05, lift=40.0):
    """The line-block distribution restated line by line, over the same lines."""
    lines, links, inside = page_lines(html)
    bare = [max(len(x) - 2 * k, 0) for x, k in zip(lines, links)]
    inner = sum(len(x) for x, i in zip(lines, inside) if i)
    outer = sum(v for v, i in zip(bare, inside) if not i)
    share = inner / (inner + outer) if inner else 0.0
    weight = [(len(x) + lift * share if x else 0.0) if i else v * (1 - share) for x, v, i in zip(lines, bare, inside)]
    sums = [sum(weight[i : i + window]) for i in range(len(lines))]
    kept, run = [], []
    for i in range(len(lines) + 1):
        if i < len(lines) and sums[i] > 1e-9:
            run.append(i)
            continue
        if run and max(sums[j] for j in run) >= surge * max(sums):
            heavy = [j for j in run if weight[j] > 0 and weight[j] >= lift * share]
            kept += [lines[j] for j in run if heavy and heavy[0] <= j <= heavy[-1] and lines[j] and weight[j] >= lift * share]
        run = []
    return "\n".join(kept)


class ArticleText(HTMLParser):
    """A second reading of well-formed pages: the words inside the article element that no part of another kind holds."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.words, self.tied = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "input", "meta", "link", "hr", "source", "wbr"):
            return
        named = {p.lower() for k, v in attrs if k in ("class", "id", "role") for p in re.findall(r"[A-Za-z]+", v or "")}
        self.stack.append((tag, tag in OTHER_TAGS or bool(named & OTHER_NAMES) and tag != "body"))

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.stack):
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        if any(t in ("article", "main") for t, _ in self.stack) and not any(gone for _, gone in self.stack):
            self.words += data.split()


OTHER_TAGS = {"nav", "header", "footer", "aside", "form", "script", "style", "button", "select", "noscript", "svg"}
OTHER_NAMES = {"ad", "ads", "advert", "sponsor", "sponsored", "promo", "banner", "nav", "menu", "sidebar", "footer", "header", "cookie", "notice", "newsletter", "share", "social", "related", "comment", "comments", "breadcrumb", "breadcrumbs", "popup", "widget", "subscribe"}


def test_html_pages_equal_slow_readings(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    same = 0
    for r in pages:
        got = main_text(r["html"])
        assert got == slow_main_text(r["html"])
        other = ArticleText()
        other.feed(r["html"])
        same += other.words == got.split()
    assert len(pages) == 250 and same >= 0.98 * len(pages)


def test_html_without_article_or_with_a_wrong_one():
    assert main_text("<div class='story'><p>Short one.</p><p>Second.</p></div>") == "Short one.\nSecond."
    story = [f"Part {i} of the long story goes on here and on and on." * 4 for i in range(4)]
    body = "".join(f"<p>{x}</p>" for x in story)
    menu = "<div><a href=x>home</a></div>" * 4
    assert main_text(f"<article><a href=x>Teaser</a> text</article>{menu}{body}{menu}") == "\n".join(story)
    assert main_text(f"{menu}<article>{body}</article>{menu}<p>Imprint and so on.</p>") == "\n".join(story)
    assert main_text("<p " + " ".join(f"a{i}='{i}'" for i in range(80_000)) + ">text</p>") == "text"


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, None, PAGE, 1), (None, "v", None, 2)], "page_id long, url string, html string, text long")
    got = extract_pages(pages).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got] == [(1, "u", 44), (1, None, 44), (None, "v", 0)] and got[2]["text"] == ""
    assert extract_pages(pages.limit(0)).count() == 0


# -- tokens -----------------------------------------------------------------------------------------------

TEXTS = ["", None, "Hello world", "  two  spaces ", "line\nbreak\n\nx", "été — naïve ñandú", "日本語 テキスト", "<s> </s> <|endoftext|> <|startoftext|>", "a\tb\r\nc", "▁odd ▁", "it's we'll 12345 !!! x", "\x00\x01", "end ", " \n ", "word " * 5000]


def test_token_counts(spark, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = table(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(2, "Hello world"), (None, "x")])
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second run finds all in the cache
        got = sorted(map(tuple, token_counts(docs, P.path("piece_bpe_32k.model"), cache).collect()), key=str)
        wanted = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in [*enumerate(TEXTS), (2, "Hello world"), (None, "x")]]
        assert got == sorted(wanted, key=str)
    assert spark.read.parquet(cache).count() == len({t or "" for t in [*TEXTS, "x"]})
    assert token_counts(docs.limit(0), P.path("piece_bpe_32k.model"), f"file://{tmp_path}/c2").count() == 0


def encoded(name, text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = [*enumerate(TEXTS), *((100 + i, words(rng, rng.randrange(300))) for i in range(40))]
    rng.shuffle(rows)
    manifest = write_token_files(table(spark, rows), f"file://{tmp_path}/ids", P.path("word_bpe_49k.json"), 1, sequence=64)
    got, at = {r["doc_id"]: r for r in read_documents(manifest).collect()}, 0
    flat = []
    for i, t in sorted(rows):
        ids = encoded("word_bpe_49k.json", t, 1)
        flat += ids
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    back = []
    for r in sorted(manifest.collect(), key=lambda r: r["file_no"]):
        file = TokenFile(r["path"])
        for s in range(len(file)):
            back += file.sequence(s)[file.mask(s).to_numpy(zero_copy_only=False)].tolist()
    assert back == flat
    assert read_documents(write_token_files(table(spark, []), f"file://{tmp_path}/none", P.path("word_bpe_49k.json"), 1)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_id_encoder_equals_the_library(name, monkeypatch):
    rng, letters = random.Random(3), "ab cdeé\n ñ日𝔘'!12 .\t A\xa0"
    encoder = encoding.IdEncoder(P.path(name))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["x" * 50_000, "<|endoftext|> a<|endoftext|>"]
    monkeypatch.setattr(encoding, "MOST_WORDS", 2000)  # the table starts anew now and then
    for lo in range(0, len(texts), 100):
        assert encoder.encode(["", *texts[lo : lo + 100]]) == [encoder.whole(t) if t else b"" for t in ["", *texts[lo : lo + 100]]]
    monkeypatch.setattr(encoding, "mix", lambda h: h & np.uint64(0xF))  # hashes that collide
    fresh = encoding.IdEncoder(P.path(name))
    assert fresh.encode(texts[:60]) == [encoder.whole(t) if t else b"" for t in texts[:60]]


def test_id_encoder_cuts_signs_off_words():
    rng, encoder = random.Random(5), encoding.IdEncoder(P.path("byte_bpe_50k.json"))
    words, signs = ["".join(rng.choice("abcdeéñ") for _ in range(9)) for _ in range(50)], [".", ",", "###", "&&&", "'", "!?", ".\n", "-\n"]
    texts = [" ".join(w + s for w in words) for s in signs]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]
    assert len(encoder.table.size) <= 2 * (len(words) + len(signs))  # not a word for each pair; a text's or line's first word has no space
    # Contractions, signs that are no ASCII, letters and signs that share a first byte, special strings in every place.
    parts = ["'s", "'", "don't", "it's", "'S", "'ll", "é", "É", "×", "÷", "e\u0301", "ı", "…", "“", "«", ".", "!'t", "a", "7", "_", " ", "\n", "<|endoftext|>", "<|", "|>", "<", "日", "ß", "\x1c", "\x7f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]


def test_toxicity_frees_what_an_earlier_stage_left_in_a_worker():
    for stage in (lambda: toxicity._score(iter([]), None), lambda: toxicity._clean(iter([]), None, 0)):
        encoding.id_encoder(P.path("byte_bpe_50k.json"))
        assert list(stage()) == [] and encoding.id_encoder.cache_info().currsize == 0


def test_words_of_letters_are_one_piece_of_the_split():
    encoder = encoding.IdEncoder(P.path("byte_bpe_50k.json"))
    letters = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]) if encoding._LETTERS(c)]
    assert len(letters) > 30_000 and all(c.isalpha() for c in letters)
    split = encoder.tokenizer.pre_tokenizer.pre_tokenize_str
    assert len(split(" " + "".join(letters))) == 1
    made = encoder._segments([(" " + c + "a" + c).encode() for c in letters])
    assert [np.array(x, dtype=encoder.dtype).tobytes() for x in made] == [encoder.whole(" " + c + "a" + c) for c in letters]


@pytest.mark.parametrize("targets", [None, {"a": 0.7, "b": 0.2, "c": 0.1}])
def test_packing(spark, targets):
    rng = random.Random(4)
    rows = [(i, t, rng.choice("aabc")) for i, t in enumerate(TEXTS)] + [(100 + i, words(rng, rng.randrange(900)), rng.choice(["a", "a", "b", None])) for i in range(80)]
    pieces = pack(table(spark, rows), P.path("byte_bpe_50k.json"), 0, sequence=128, targets=targets).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t, _ in rows:
        ids, at = encoded("byte_bpe_50k.json", t, 0), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]]) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for s, some in by_sequence.items():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 128 or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert pack(table(spark, []), P.path("byte_bpe_50k.json"), 0).count() == 0


def test_packing_sequences_hold_the_targets(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 400), "abc"[i % 3]) for i in range(300)]
    docs = table(spark, rows)
    for targets in ({"a": 0.5, "b": 0.25, "": 0.25}, None):
        pieces = pack(docs, P.path("byte_bpe_50k.json"), 0, targets=targets).join(docs.select("doc_id", "source"), "doc_id")
        shares = pieces.groupBy("sequence_id").pivot("source", ["a", "b", "c"]).agg(F.sum("length") / 1024).orderBy("sequence_id").fillna(0).collect()
        wanted = (0.5, 0.25, 0.25) if targets else (1 / 3,) * 3
        full = shares[: len(shares) // 2]  # before a queue runs dry
        assert len(full) > 50 and all(abs(r[i + 1] - w) <= 2 * 64 / 1024 for r in full for i, w in enumerate(wanted))
        for n in range(1, len(full)):  # deficits are carried, they do not add up
            assert all(abs(sum(r[i + 1] for r in full[:n]) - n * w) <= 0.2 for i, w in enumerate(wanted))


def test_packing_plan_covers_many_queues():
    rng = random.Random(1)
    for case in range(12):
        n_queues = rng.choice([1, 5, 300])
        tokens = [rng.choice([0, 1, 64, 5000, rng.randrange(100_000)]) for _ in range(n_queues)]
        targets = None if case % 2 else [rng.choice([0.0, 1.0, 5.0]) for _ in tokens]
        phases = packing.plan(tokens, targets, 1024, 64)
        queue, at, n = (np.array(x, dtype=np.int64) for x in zip(*[(j, x, min(700, t - x)) for j, t in enumerate(tokens) for x in range(0, t, 700)] or [(0, 0, 0)]))
        row, start, length, position = packing.cuts(phases, queue, at, n, 1024, 64)
        order = np.argsort(position)
        assert (position[order] == np.cumsum(length[order]) - length[order]).all() and length.sum() == sum(tokens)
        assert (np.bincount(row, weights=length, minlength=len(n)) == n).all() and (position // 1024 == (position + length - 1) // 1024).all()


# -- toxicity ---------------------------------------------------------------------------------------------


def toxic_corpus(n=400, seed=9):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        w = [f"{rng.choice(['ma', 'lo', 'ti', 'ren', 'sta'])}{rng.choice(['bel', 'non', 'ker', 'dim'])}{rng.choice(['a', 'es', 'ing'])}" for _ in range(rng.randrange(8, 60))]
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["grubhead", "slimeball", "dirtbag", "grub-head", "s l i m e b a l l", "dirrtbag"])
        rows.append((i, " ".join(w) + ". " + "Fine day here."))
        labels.append((i, 0, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, marks).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    # Held-out labels have no part in the model.
    other = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, other).collect()} == {r["doc_id"]: r["score"] for r in got}
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}


def test_toxicity_sample_passes_over_a_huge_text(monkeypatch):
    rows, labels = toxic_corpus()
    monkeypatch.setattr(toxicity, "MOST_BYTES", 50_000)
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 60_000, *(t for _, t in rows)]), pa.array([0, *(t for _, _, t in labels)])], names=["text", "toxic"])
    (made,) = toxicity._fit(iter([batch]), None)
    assert np.abs(pickle.loads(made.column(0)[0].as_py()).table).max() > 0


def test_toxicity_edges(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, [(1, None), (None, "x y"), (2, ""), (2, "a" * 100_000)]).withColumn("score", F.lit("clash"))
    got = toxicity.toxicity_scores(docs, marks).collect()
    assert len(got) == 4 and all(r["predicted"] == 0 for r in got)
    assert toxicity.keep_clean(docs, marks).count() == 4 and toxicity.toxicity_scores(docs.limit(0), marks).count() == 0
    one = spark.createDataFrame([(1, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity_scores(docs, one).collect()} == {1}


# -- spans, leaks, copies, lines --------------------------------------------------------------------------


def test_span_dedup(spark):
    rng = random.Random(2)
    passage = " ".join(words(rng, 12).capitalize() + "." for _ in range(6))
    rows = [(i, words(rng, 30).capitalize() + ". " + (passage if i in (3, 5, 9) else words(rng, 40).capitalize() + ".") + f" Tail {i} {words(rng, 9)}.") for i in range(12)]
    got = {r["doc_id"]: r for r in drop_repeated_spans(table(spark, rows)).collect()}
    text = dict(rows)
    assert got[3]["text"] == text[3] and got[3]["n_removed"] == 0
    for i in (5, 9):
        assert got[i]["n_removed"] == 6 and "".join(s for s in sentences(text[i]) if s.strip() not in passage) == got[i]["text"]
    assert all(got[i]["text"] == text[i] for i in text if i not in (5, 9))
    edge = drop_repeated_spans(table(spark, [(1, None), (2, ""), (None, passage), (4, passage), (4, passage)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in edge) == [(-1, 6), (1, 0), (2, 0), (4, 0), (4, 0)]
    assert drop_repeated_spans(table(spark, [])).count() == 0


def brute_spans(rows):
    """Sentences in any run of two or more sentences and twenty words that stands at an earlier place too."""
    first, runs, out = {}, [], {}
    for i, t in sorted(rows):
        found = sentences(t)
        bare = [" ".join(x.lower().split()) for x in found]
        for a in range(len(found)):
            for b in range(a + 1, len(found)):
                if sum(len(x.split()) for x in bare[a : b + 1]) >= 20:
                    key = tuple(bare[a : b + 1])
                    runs.append((i, a, b, key))
                    first.setdefault(key, (i, a))
        out[i] = [found, set()]
    for i, a, b, key in runs:
        if first[key] != (i, a):
            out[i][1] |= set(range(a, b + 1))
    return {i: "".join(x for n, x in enumerate(found) if n not in gone) for i, (found, gone) in out.items()}


def test_span_dedup_equals_brute_force(spark):
    rng = random.Random(31)
    pool = [words(rng, rng.choice([3, 8, 15, 40]), 5000) + rng.choice([".", "!", "\n", " "]) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.6 else words(rng, 10, 5000) + "." for _ in range(rng.randrange(14)))) for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in drop_repeated_spans(table(spark, rows).withColumn("spans", F.lit(1)).withColumn("gone_id", F.lit(2))).collect()}
    wanted = brute_spans(rows)
    assert got == wanted and sum(wanted[i] != t for i, t in rows) > 20


def test_span_dedup_finds_a_passage_inside_longer_sentences(spark):
    rng = random.Random(32)
    passage = words(rng, 60, 5000)
    rows = [(i, f"{words(rng, 7 + i, 5000)} {passage} {words(rng, 5 + i, 5000)}.") for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in drop_repeated_spans(table(spark, rows)).collect()}
    assert got[0] == rows[0][1] and all(len(got[i].split()) < len(t.split()) - 35 for i, t in rows[1:])
    long = "one two three. " * 60_000
    (kept,) = drop_repeated_spans(table(spark, [(1, long)])).collect()
    assert len(kept["text"]) < 200


def test_span_dedup_keeps_other_texts_of_an_id(spark):
    rng = random.Random(3)
    passage = " ".join(words(rng, 12).capitalize() + "." for _ in range(4))
    clean = [" ".join(words(rng, 12, 5000).capitalize() + "." for _ in range(6)) for _ in range(3)]
    rows = [(1, passage), (None, passage + " " + clean[0]), (None, clean[1]), (7, passage + " " + clean[2]), (7, clean[0][:40])]
    got = {(r["doc_id"], r["n_removed"], r["text"]) for r in drop_repeated_spans(table(spark, rows)).collect()}
    assert got == {(1, 0, passage), (None, 4, clean[0]), (None, 0, clean[1]), (7, 4, clean[2]), (7, 0, clean[0][:40])}


def tokens_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute_leaks(rows, items, percent=80):
    found = set()
    for i, t in rows:
        d = tokens_of(t)
        for k, q in items:
            q = tokens_of(q)
            w = min(len(q), 16)
            if k is not None and w and any(
                100 * sum(x == y for x, y in zip(d[a : a + w], q[b : b + w])) >= percent * w for a in range(len(d) - w + 1) for b in range(len(q) - w + 1)
            ):
                found.add((i, k))
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    items = [(i, words(rng, n, 5000)) for i, n in enumerate([1, 3, 4, 5, 6, 7, 8, 9, 11, 12, 16, 20, 40])] + [(90, None), (91, "..."), (92, ""), (None, "w1 w2 w3 w4 w5")]
    rows = [(i, words(rng, 60, 5000)) for i in range(60)] + [(None, None), (200, ""), (201, items[5][1])]
    for n in range(45):
        w = items[n % 13][1].split()
        for _ in range(len(w) * (n % 3) // 10):  # none, or up to a fifth
            w[rng.randrange(len(w))] = "substituted"
        rows[n] = (n, words(rng, 9, 5000) + " " + " ".join(w).upper() + ", " + words(rng, 9, 5000))
    docs, tests = table(spark, rows).withColumn("item_id", F.lit("clash")).withColumn("gone_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    wanted = brute_leaks(rows, items)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated_pairs(docs, tests).collect()}
    assert got == wanted and len(wanted) > 30
    kept = keep_uncontaminated(docs, tests)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in wanted}
    assert contaminated_pairs(docs, tests.limit(0)).count() == 0 and contaminated_pairs(docs.limit(0), tests).count() == 0
    assert keep_uncontaminated(docs, tests.limit(0)).count() == docs.count()


def test_decontamination_of_repeated_words(spark):
    rows = [(1, "a " * 20_000), (2, "a b " * 10_000), (3, "c " * 30)]
    tests = spark.createDataFrame([(1, "a " * 2_000), (2, "a b " * 1_000)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated_pairs(table(spark, rows), tests).collect()} == {(1, 1), (2, 2)}


def test_masks_find_permitted_substitutions():
    from itertools import combinations

    from gaugework.llm.decontaminate import SPAN, masks_for

    for n in range(1, 17):
        ways = list(combinations(range(n), n - (80 * n + 99) // 100))
        hit = [any(all(p + m not in way for m in mask) for mask in masks_for(n, 80) for p in range(n - min(n, SPAN) + 1)) for way in ways]
        assert sum(hit) >= (0.93 if n == 10 else 1.0) * len(ways)


def test_settings_and_clashing_names(spark):
    assert [common._bytes(x) for x in ("64m", "65536", "65536b", "1g", "2MB")] == [64 << 20, 65536, 65536, 1 << 30, 2 << 20]
    docs = table(spark, [(1, "a"), (2, "a")]).withColumn("gone_id", F.lit(5)).withColumn("gone_digest", F.lit("x"))
    kept = keep_one_of_equals(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (5, "b"), (5, "b"), (6, "A"), (7, "x" * 200_000)]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_groups(table(spark, rows)).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    wanted = [(1, 2, 3, False, sha("a")), (2, 2, 3, True, sha("a")), (None, 2, 3, False, sha("a")), (3, 4, 2, False, sha("")), (4, 4, 2, True, sha("")), (5, 5, 2, True, sha("b")), (5, 5, 2, True, sha("b")), (6, 6, 1, True, sha("A")), (7, 7, 1, True, sha("x" * 200_000))]
    assert got == sorted(wanted, key=str)
    assert sorted(r["doc_id"] for r in keep_one_of_equals(table(spark, rows)).collect()) == [2, 4, 5, 5, 6, 7]
    assert sorted((r["doc_id"], r["text"]) for r in keep_one_of_equals(table(spark, [(1, "a"), (1, "b"), (2, "a")])).collect()) == [(1, "b"), (2, "a")]
    assert exact_groups(table(spark, [])).count() == 0


def test_directory_splits_and_doubles():
    depth, slots = directory({0: 10, 1: 1, 2: 1, 3: 1}, capacity=5, most_bits=2)
    assert depth == 2 and slots == [4, 5, 3, 3]
    assert directory({}, 5, 4) == (0, [1])
    assert directory({0: 10, 1: 1, 2: 9, 3: 1}, 5, 2, [4, 5, 3]) == (2, [4, 5, 6, 7])


def test_exact_index_takes_a_second_batch(spark, tmp_path, monkeypatch):
    """Buckets split and the directory doubles when a second batch opens the stored index."""
    monkeypatch.setattr(exact_dedup, "CAPACITY", 8)
    path = f"file://{tmp_path}/index"
    one = [(i, f"text {i % 40}") for i in range(60)]
    two = [(100 + i, f"text {i}") for i in range(300)] + [(None, "text 3"), (999, None)]
    build_index(table(spark, one), path)
    before = {r["bucket"] for r in spark.read.parquet(f"{path}/directory").collect()}
    got = groups_of(extend_index(table(spark, two), path)).collect()
    slots = spark.read.parquet(f"{path}/directory").where("gen = 1").collect()
    assert len({r["bucket"] for r in slots}) > len(before) and len(slots) > len(before)
    third = groups_of(extend_index(table(spark, [(2000, "text 3")]), path)).collect()
    assert {r["of"] for r in spark.read.parquet(f"{path}/directory").where("gen = 2").collect()} == {1, 2}  # one bucket was written anew
    for rows, found in ((one + two, got), ([*one, *two, (2000, "text 3")], third)):
        wanted = {}
        for i, t in rows:
            wanted.setdefault(t or "", []).append(i)
        have = {}
        for r in found:
            have.setdefault(r["text_sha256"], []).append(r)
        assert len(have) == len(wanted)
        for t, ids in wanted.items():
            some = have[hashlib.sha256(t.encode()).hexdigest()]
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in some) == sorted((i is None, i or 0) for i in ids)
            assert {(r["keep_id"], r["group_size"]) for r in some} == {(max(i for i in ids if i is not None), len(ids))}


def brute_lines(rows, least, shortest):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    counts = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(key(x)) >= shortest and counts[key(x)] >= least)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [3, 10])
def test_line_dedup(spark, least):
    rng = random.Random(6)
    pool = ["Home", " home ", "HOME\t", "É", "é", "", " ", "Terms of use", "x"]
    rows = [(i, "\n".join([*rng.choices(pool, k=rng.randrange(6)), words(rng, 3)])) for i in range(40)] + [(100, None), (101, ""), (102, "\n"), (None, "Home\nx"), (103, "Terms of use")]
    got = sorted(map(tuple, drop_frequent_lines(table(spark, rows), least, 1).collect()), key=str)
    assert got == brute_lines(rows, least, 1)
    assert drop_frequent_lines(table(spark, [])).count() == 0


def test_line_runs_merge_in_order(spark):
    """Runs are read sorted and by bucket, and levels are compacted between batches."""
    runs = Runs(spark, fanout=2)
    with _sorted_scans(spark):
        for b in range(5):
            keys = spark.range(40).select((F.col("id") % 20 + b).alias("hash"), F.hash(F.col("id") % 20 + b).alias("check"))
            counted = runs.unseen(keys.groupBy("hash", "check").agg(F.count("*").alias("n_docs")), 4)
            if b == 4:
                plan = counted._jdf.queryExecution().executedPlan().toString()
                joins, sorts, exchanges = (plan.count(x) for x in ("SortMergeJoin", "Sort [", "Exchange hash"))
                assert joins == len(runs.all()) and sorts == 1 and exchanges == 1
            runs.add(counted)
        assert runs.merges == 3 and [len(x) for x in runs.levels] == [1, 0, 1]
        total = {r["hash"]: r["n_docs"] for run in runs.all() for r in run.collect()}
    runs.drop()
    assert total[0] == 2 and total[2] == 4 and max(total.values()) <= 8
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == "true"


# -- queries ----------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows, labels = toxic_corpus(400)
    test = words(rng, 40, 5000)
    near = words(rng, 200, 5000)
    rows += [(500, rows[1][1]), (501, test), (502, near), (503, near + " more words"), (504, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    toxic = {i for i, _, t in labels if t}
    assert len(left & toxic) <= 6
    assert [i for i in (1, 500, 501, 502, 503) if i in left] == [500, 502]
    assert len({i for i, _ in rows if i < 400} - toxic - {1} - left) <= 2
    # The whole against brute force: the classifier's decisions, then equal texts, links, leaks, and every id in its place.
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    stay = [(i, t or "") for i, t in rows if not scores[i]]
    last = {}
    for i, t in stay:
        last[t] = max(i, last.get(t, i))
    stay = [(i, t) for i, t in stay if last[t] == i]
    components = brute_components(stay, 5, 80)
    stay = [(i, t) for i, t in stay if components[i][1] == i]
    leaks = {i for i, _ in brute_leaks(stay, [(1, test)])}
    stay = [(i, t) for i, t in stay if i not in leaks]
    pieces = {}
    for r in out.orderBy("doc_id", "start").collect():
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], b"") + bytes(r["ids"])
    assert pieces == {i: np.array(encoded("byte_bpe_50k.json", t, 0), dtype="<u4").tobytes() for i, t in stay}
    places = sorted((r["sequence_id"] * 1024 + r["offset"], r["length"]) for r in out.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    docs = table(spark, [(1, long), (2, long + " end"), (3, "\n".join(["line"] * 100_000))])
    assert {r["doc_id"]: r["component_id"] for r in ngram_components(docs, 4, 85).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["n_lines"] for r in drop_frequent_lines(docs, 2, 1).collect()} == {1: 1, 2: 1, 3: 100_000}
    tests = spark.createDataFrame([(1, "w70000 w70001 w70002 w70003 w70004 w70005")], "item_id long, text string")
    assert {r["doc_id"] for r in contaminated_pairs(docs, tests).collect()} == {1, 2}
    assert {r["doc_id"] for r in keep_one_of_equals(docs).collect()} == {1, 2, 3}


def test_shared_folder_comes_from_the_session(spark):
    assert common.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
