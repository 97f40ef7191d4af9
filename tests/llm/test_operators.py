"""Small cases of the corpus operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann, chat, exact_dedup, html_content, jaccard, licenses, mixing, packing, queries, sharding, toxicity
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(9000))
ROWS = [
    (1, "a b c d e f g h i j", "s1"), (2, "a b c d e f g h i j", None), (3, None, "s2"), (4, "", "s2"), (None, "x y", "s1"),
    (6, LONG, "s1"), (7, LONG + " end", "s3"), (8, LONG, "s3"), (9, "all rights reserved CC BY cc by", "s2"), (9, "all rights reserved CC BY cc by", "s2"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert differences(spark, connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) == []


def test_exact_duplicates(docs):
    got = exact_dedup.exact_duplicates(docs, block=64).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    assert len(got) == len(ROWS)
    for r in got:
        g = groups[r.text or ""]
        assert r.group_size == len(g) and r.keep_id == max((i for i in g if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_shards(docs):
    got = sharding.shard_by_bytes(docs, 3).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, len((t or "").encode()) + 16) for i, t, _ in ROWS)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_shards_are_contiguous_and_balanced(spark):
    """Cuts of one order: groups of copies stay whole unless larger than a shard, and no cut is off by more than half a unit."""
    rng = np.random.default_rng(5)
    rows = [(i, f"small text {i} " * int(rng.integers(1, 9))) for i in range(800)]
    rows += [(1000 + i, f"copied {i % 40}") for i in range(400)] + [(2000 + i, "many copies " * 5) for i in range(3000)] + [(None, None), (None, None), (5, rows[5][1])]
    df = spark.createDataFrame([(i, t, "x", 7, 8) for i, t in rows], "doc_id long, text string, shard string, w int, __n int")
    n = 7
    got = sharding.shard_by_bytes(df, n).collect()
    key = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode()) + 16
    total = sum(size(t) for _, t in rows)
    groups, want, before = defaultdict(list), defaultdict(list), 0
    for i, t in rows:
        groups[key(t)].append((i is not None, i or 0, size(t)))
    for k in sorted(groups):
        parts = sorted(groups[k])
        whole = sum(p[2] for p in parts) * n <= total
        for unit in [parts] if whole else [[p] for p in parts]:
            many = sum(p[2] for p in unit)
            at = min(n - 1, (2 * before + many) * n // (2 * total))
            want[at] += [(p[1] if p[0] else None, p[2]) for p in unit]
            before += many
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert r.slot == len(found[r.shard]) and r.w == 7
        found[r.shard].append((r.doc_id, r.size))
    assert found == want
    load = [sum(s for _, s in found[k]) for k in range(n)]
    assert max(load) - min(load) <= 2 * max(sum(p[2] for p in g) for g in groups.values() if sum(p[2] for p in g) * n <= total)


def test_similar_groups(docs):
    got = {(r.doc_id, (r.text or "")[:5]): r for r in jaccard.similar_groups(docs).collect()}
    assert got[2, "a b c"].component_id == 1 and got[1, "a b c"].n_shingles == 6
    assert got[7, "w0 w1"].component_id == 6 and got[8, "w0 w1"].component_id == 6
    assert got[3, ""].component_id == 3 and got[3, ""].n_shingles == 0
    assert jaccard.similar_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [3, 1000])
def test_similar_groups_around_origins(spark, crowd):
    """Groups of copies with more or fewer changes, some of them the same ones, against all pairs."""
    rng, texts = np.random.default_rng(7), []
    for _ in range(3):
        origin = [f"w{x}" for x in rng.integers(0, 5000, 90)]
        edits = [(int(at), f"e{at}") for at in rng.integers(0, 90, 8)]
        for many in [0, *rng.integers(0, 7, 50)]:
            text = list(origin)
            for k in rng.integers(0, 8, many):
                if rng.random() < 0.5:
                    text[edits[k][0]] = edits[k][1]
                else:
                    text[rng.integers(0, 90)] = f"x{rng.integers(0, 9999)}"
            texts.append(" ".join(text[rng.integers(0, 4) :]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(set(least)) > 6
    assert {r.doc_id: r.component_id for r in jaccard.similar_groups(df, crowd=crowd).collect()} == dict(enumerate(least))


def test_mix(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size
    assert mixing.mix(docs.limit(0)).count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(0)
    counts = defaultdict(int)
    for n in rng.integers(1, 2049, 3000):
        counts[int(n)] += 1
    used, fill = defaultdict(int), defaultdict(list)
    for n, first, k, b, at in packing.plan(dict(counts)):
        used[n] += k
        for j in range(k):
            fill[b + j].append((at, n))
    assert used == counts
    for places in fill.values():
        at = 0
        for start, n in sorted(places):
            assert start == at
            at += n
        assert at <= 2048
    assert len(fill) <= 1.03 * sum(n * c for n, c in counts.items()) / 2048


def test_tokenizer_matches_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = ["Hello  world\n\n it's 12,5 ünïcode 中文", "", "a<|endoftext|>b", " " * 30 + "x"]
    rng = np.random.default_rng(3)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "'s", "12", "é中", "<|endoftext|>", "<|endo", "!?", "\x1c", "\x85", "\u200b"]
    texts += ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    own = [ids.tolist() for ids in packing.Encoder(path).encode(texts)]
    assert own == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_long_white_space_is_packed(spark):
    """Runs of over a million white-space characters give the ids of the library."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = [f"one{c * (1_100_000 // len(c))}two<|endoftext|> three{c}" for c in (" ", "\n", "\r\n", "\u3000")]
    library, found = Tokenizer.from_file(path), defaultdict(list)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pack(df, path, with_ids=True).orderBy("doc_id", "piece").collect():
        assert r.start == len(found[r.doc_id])
        found[r.doc_id] += r.ids
    assert dict(found) == {i: [*library.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<s> </s>[INST]\\[/INST] <\\s>"), (1, 1, "assistant", "<\\\\/s>[\\INST]é"), (2, None, None, None), (2, 1, "assistant", "")]
    got = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    said = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest() and got[2].n_turns == 2 and got[2].loss_chars == 0


def test_licenses(docs):
    got = [r for r in licenses.licensed(docs).collect() if r.doc_id == 9]
    assert len(got) == 2 and all(r.n_base == 3 and r.first_word == 0 and r.last_word == 5 and r.base_labels == "cc-by,reserved" for r in got)
    assert licenses.licensed(docs.limit(0)).count() == 0 and len(licenses.rules()) > 200


def test_nearest_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (None, x[0].tolist())]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    found = 0
    for q, ids in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        found += len(set(ids) & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 30 and found / (20 * len(got)) >= 0.9


def test_nearest_by_cells(spark):
    """Many cells, a third of all rows equal, repeated ids and vectors of another length: every score is exact and the nearest are found."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16)) * 3
    x = centres[rng.integers(0, 40, 2400)] + 0.1 * rng.standard_normal((2400, 16))
    x[::3] = x[0]
    ids = np.arange(2400)
    ids[2399] = 40
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(5000, [1.0, 2.0]), (5001, [3.0, 1.0]), (5020, [0.5, 0.5])]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), cell=64, queries=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[5000] == [(5001, 5.0), (5020, 1.5)] and got[5020] == [(5001, 2.0), (5000, 1.5)]
    assert len(got[40]) == 40  # two rows, each a query of its own
    hit = total = 0
    for q in range(0, 2400, 20):
        if q == 40:
            continue
        s = x @ x[q]
        s[q] = -np.inf
        want = [int(ids[i]) for i in np.lexsort((ids, -np.round(s, 10)))[:20]]
        hit, total = hit + len(set(want) & {i for i, _ in got[q]}), total + 20
        assert len(got[q]) == 20 and all(any(abs(x[q] @ x[j] - v) < 1e-9 for j in np.flatnonzero(ids == i)) for i, v in got[q])
    assert hit / total >= 0.9


def test_nearest_stops_early():
    """On clustered vectors the stopping test leaves most leaves unvisited; on a tree with equal points every point has its cell."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((300, 32)) * 4
    x = centres[rng.integers(0, 300, 20_000)] + 0.05 * rng.standard_normal((20_000, 32))
    longest = float(np.sqrt((x * x).sum(1).max()))
    px, at = ann.projected(x, longest), np.arange(len(x))
    q = np.arange(0, 20_000, 400)
    _, where, seen = ann.search_block(x, px, at, at, x[q], q, np.full(len(q), -np.inf), 20, longest)
    want = [set(np.argsort(np.where(at == i, np.inf, -(x @ x[i])))[:20]) for i in q]
    assert np.mean([len(w & set(g)) / 20 for w, g in zip(want, where.tolist(), strict=True)]) >= 0.9
    assert seen.mean() < 0.6 * len(ann._kd_leaves(px, ann.LEAF))
    px[::2] = px[0]
    nodes = ann.cell_tree(px, 37)
    cells = ann.route(px, nodes)
    assert len(set(cells[::2])) == 1 and set(cells) == set(range(int((nodes[:, 0] < 0).sum()))) and len(set(cells)) <= 37
    assert (ann.route(px, ann.cell_tree(px[:0], 5)) == 0).all()


def test_html():
    model = html_content.train()
    page = "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A  title</h1><p>First &amp; text, of some length.<p>Second <b>text</b>\n here, it goes on.</article><footer>&copy; me</footer></body></html>"
    assert html_content.main_text(page, model)[0] == "A title\nFirst & text, of some length.\nSecond text here, it goes on."
    assert html_content.main_text("", model)[0] == ""


def test_marginals_match_enumeration():
    moves, odds = np.array([[0.3, -0.2], [0.1, 0.5]]), np.array([0.5, 2.0, 0.1, 3.0])
    p = toxicity.marginals(odds, np.array([4]), moves)
    total, hit = 0.0, np.zeros(4)
    for k in range(16):
        y = [(k >> i) & 1 for i in range(4)]
        w = np.prod([odds[i] if y[i] else 1 for i in range(4)]) * np.exp(sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        hit += w * np.array(y)
    assert np.allclose(p, hit / total)


def test_toxicity_scores(docs, spark):
    # Texts must not be near copies of each other: those count as one.
    texts = [f"first{i}{w} {w} second{i * 7}{w} third{i * 11}{w} fourth{i * 13}{w}" for i in range(40) for w in ("awfulzz", "nice")]
    model = toxicity.fit(texts, [1, 0] * 40)
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([(1, "such an awfulzz thing"), (2, None), (3, "a fine thing")], "doc_id long, text string"), model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3].predicted == 0
    assert got[1].spans[0].start == 8 and got[1].spans[0].end == 15


def test_licenses_settle_in_order_of_priority(spark):
    """Clashing names are no trouble; what a better detection suppresses suppresses nothing; base places as a scan of the words."""
    table = [(0, "a", "one", "one two three"), (1, "b", "three", "three four five"), (2, "c", "five", "five six"), (3, "d", "two", "two")]
    rows = [(1, "One two, three-four five six", 5), (2, None, None), (3, "", 1), (4, "x cc by cc by all rights reserved cc by-cc by!", 2), (4, "x cc by cc by all rights reserved cc by-cc by!", 2), (5, "ünï cc bY", 0)]
    df = spark.createDataFrame([(i, t, x, "q", "z") for i, t, x in rows], "doc_id long, text string, w int, m string, __rid string")
    out, found = licenses.scan(df, table)
    assert sorted((r.label, r.start) for r in found.collect()) == [("a", 1), ("c", 20)]
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [r.labels for r in got] == ["a,c", "", "", "cc-by,reserved", "cc-by,reserved", "cc-by"] and [r.w for r in got][0] == 5
    for r, (_, t, _) in zip(got, rows, strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [i for p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))


def test_html_keeps_inline_content_in_its_line_and_parses_deep_pages():
    import time

    model = html_content.default_model()
    page = "<article><h1>On numbers and their names</h1><p>Let <math><mi>x</mi></math> be a number, and <svg><text>y</text></svg> another one <button>Go</button>of them.<p>It has <audio>sound</audio> too, as all <noscript>numbers</noscript> have.</article><script src=a />var hidden = 1;</script>"
    text = html_content.main_text(page, model)[0]
    assert "Let x be a number, and y another one of them." in text and "hidden" not in text and "Go" not in text
    began = time.time()
    assert len(html_content.parse("<div>" * 20000 + "</p>" * 20000 + "<i><div>" + "<span>" * 5000 + "</i>" * 5000)) == 20002
    assert time.time() - began < 5


def test_html_rows(spark):
    rows = [(1, "u", None, "c1"), (1, "u", None, "c1"), (2, None, "", "c"), (None, "v", "<article><p>One whole sentence, which is all there is.<p>And another one, which comes after it.</article", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_content.extract(df).collect()))
    assert got[1:] == [(1, "", 0), (1, "", 0), (2, "", 0)] and got[0][2] == len(got[0][1]) > 0
    assert html_content.extract(df.limit(0)).count() == 0


def test_operators_on_empty_tables_and_clashing_names(spark, docs):
    """Empty tables give empty results; columns of docs with names used inside or added give way or stay."""
    none = docs.limit(0)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    model = toxicity.train(none, labels)
    assert toxicity.score(none, model).count() == 0
    scored = toxicity.score(docs.withColumn("score", F.lit("x")).withColumn("w", F.lit(1)), model).collect()
    assert len(scored) == len(ROWS) and {r.predicted for r in scored} == {0} and {r.w for r in scored} == {1}
    assert packing.pack(none, queries.tokenizer_path()).count() == 0
    twice = packing.pack(docs.withColumn("ids", F.lit(1)), queries.tokenizer_path()).collect()
    assert sum(r.doc_id == 9 for r in twice) == 2 and sum(r.length for r in twice if r.doc_id in (3, 4)) == 2
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, None)], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(turns.limit(0)).count() == 0 and chat.format_chat(turns).first().n_turns == 3
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.0]), (4, [1.0])], "vec_id long, embedding array<double>")
    assert ann.nearest(vectors.limit(0)).count() == 0
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(vectors).collect() if r.query_id == 20)
    assert got == [(20, 1, 0), (20, 2, 0), (20, 3, 3)]


def test_keep_one_and_training_order(spark):
    """Of each near group the least id stays, and a mix's rows come in the order of their positions."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "a"), (3, long + " end", "b"), (7, "other words that stand alone here", "b"), (8, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == [3, 7, 8]
    mixed = mixing.mix(df)
    order = mixing.training_order(mixed).select("position").collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and len(order) == sum(r.copies for r in mixed.collect())
