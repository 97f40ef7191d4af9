"""Repeated passages, conversation repair, collocations and row ids against brute force on small cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, jaccard, mixing, phrases, queries, repair, repeats

SF = "/root/testdata/sf0.001"


def brute_repeats(texts, width):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone, end = bytearray(len(r)), 0
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[max(i, end) : i + width] = b"\1" * (i + width - max(i, end))
                end = i + width
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(3)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    base = [word("abcdeé ", rng.randint(0, 500)) for _ in range(40)]
    texts = [None, "", "a" * 300, "ab" * 200, "a" * 39, base[0] + base[0]] + base
    for _ in range(160):
        t, k = rng.choice(base), rng.random()
        i = rng.randint(0, len(t))
        j = rng.randint(i, len(t))
        texts.append(t if k < 0.3 else t[:i] + "x" + t[i + 1 :] if k < 0.6 else word("pqr", 50) + t[i:j] + word("pqr", 50) if k < 0.8 else t + rng.choice(base))
    return texts


@pytest.mark.parametrize("shape", [(40, 10, 11, 10_000), (40, 10, 11, 3), (60, 12, 31, 5)])
def test_repeats(spark, shape):
    """Groups that fit, and groups halved down to single windows."""
    texts, (width, gram, block, group) = passages(), shape
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, rid int, start int")
    got = repeats.without_repeats(df, width, gram, block, group, bits=16).collect()
    want = brute_repeats(texts, width)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_repeats_of_a_long_text_and_repeated_rows(spark, monkeypatch):
    """Texts longer than a worker's slice; rows with one id or none; an empty table."""
    monkeypatch.setattr(repeats, "SLICE", 1000)
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(7000))
    rows = [(1, long), (1, long[2500:5200] + "!"), (None, "z" * 3000), (None, "short"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    slices = list(repeats._slices(iter(df.withColumn("__rid", F.lit(1).cast("long")).toArrow().to_batches()), 400))
    assert max(len(s[0]) for s in slices) < 2 * 1400
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df, bits=16, with_text=False).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, brute_repeats([t for _, t in rows], 400), strict=True))
    assert repeats.without_repeats(df.limit(0), bits=16).count() == 0


def test_anchors_cover_every_window_once():
    """Every window belongs to one anchor, whose place depends on the window's bytes alone."""
    rng = np.random.default_rng(1)
    for data in (rng.integers(97, 100, 3000).astype(np.uint8), np.full(900, 97, np.uint8), np.tile(np.frombuffer(b"abcde", np.uint8), 300)):
        valid = np.ones(len(data) - 59, bool)
        valid[200:260] = False
        place, _, first, last = repeats.anchors(data, valid, 60, 12)
        owner = {}
        for p, a, b in zip(place, first, last, strict=True):
            for s in range(a, b + 1):
                assert s not in owner
                owner[s] = p - s
        assert sorted(owner) == list(np.flatnonzero(valid))
        by_bytes = defaultdict(set)
        for s, d in owner.items():
            by_bytes[data[s : s + 60].tobytes()].add(d)
        assert all(len(v) == 1 for v in by_bytes.values())


def test_collection_orders_suffixes():
    """After each round the order is that of the suffixes, with the common prefixes of neighbours."""
    rng = random.Random(2)
    right = [bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(40)]
    group = np.array([rng.randint(0, 2) for _ in right])
    held, table = repeats.Collection(group), repeats._symbols(right, 6)
    for t in range(5, -1, -1):
        held.insert(table[:, t], True)
        suffix = [(group[i], right[i][t:]) for i in held.order]
        assert suffix == sorted(suffix)
        for i in range(1, len(suffix)):
            common = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(suffix[i - 1][1], suffix[i][1], strict=True))))
            assert held.shared[i] == (common if suffix[i - 1][0] == suffix[i][0] else -1)


def brute_audit(codes):
    """All audits, shortest costs first: uniform-cost search over (row, state)."""
    import heapq

    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(codes) and q in (0, 3):
            return cost, audit
        grow = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}[q]
        heapq.heappush(heap, (cost + 5, audit + "I", i, grow[1]))
        if i < len(codes):
            initial, fault = codes[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q))
            if fault not in "bd":
                more = 5 * (fault == "t")
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, grow[1]))
                if initial == grow[0] or initial == "s" and q == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1 if initial == "s" else grow[1]))


def test_cheapest_edits(monkeypatch):
    """Costs and tie-breaks against a search; short links put the audit together from many parts."""
    rng = random.Random(5)
    for link in (512, 1, 3):
        monkeypatch.setattr(repair, "LINK", link)
        for _ in range(250):
            codes = [rng.choice("ssuuuaa?") + rng.choice("bdtt----") for _ in range(rng.randint(0, 12))]
            assert repair.cheapest(codes) == brute_audit(codes), codes


def plain_repair(rows):
    """rows of one conversation, damaged already, in order: counts, cost, audit, repaired rows."""
    seen, codes, faults = set(), [], Counter()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        faults[fault] += 1
        codes.append((role[:1] if role[:1] in ("s", "u", "a") else "?") + fault)
    cost, audit = brute_audit(codes)
    out, i, q = [], 0, 0
    for e in audit:
        grow = {0: "user", 1: "user", 2: "assistant", 3: "user"}[q]
        if e == "I":
            out.append((grow, ""))
        else:
            if e != "D":
                out.append((rows[i][1] if e == "K" else grow, rows[i][2]))
            i += 1
            if e == "D":
                continue
        q = {"s": 1, "u": 2, "a": 3}[out[-1][0][0]]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def test_repair(spark):
    """Nulls, ties, repeated and long rows, conversations without rows; other columns; against plain Python from the input rows."""
    rng = random.Random(6)
    rows = []
    for conv in [None, *range(60)]:
        for turn in [None, *range(rng.randint(0, 9))]:
            if rng.random() < 0.9:
                rows.append((conv, turn, rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No", "a b. ", None, "", "Is it?\n", "!" * 3, "e é."])))
    rows += [(500, t, "user", "x. " * 2000 + str(t % 7)) for t in range(300)] + [(501, 3, "user", "Same."), (501, 3, "user", "Same."), (501, 3, "assistant", "Same.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, edit string")
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else said(role), "" if kind == 1 else re.sub("[.!?]", "", said(text)) if kind == 2 else said(text)
        want[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in repair.digest(repair.damage(df)).collect()}
    assert len(got) == len(want)
    for conv, some in want.items():
        assert got[conv] == plain_repair(sorted(some, key=order)), conv
    found, turns = repair.repair(repair.damage(df))
    initials = defaultdict(list)
    for r in turns.collect():
        initials[r.conv_id].append((r.place, r.role[0]))
    assert all(re.fullmatch("(s?(ua)+)?", "".join(c for _, c in sorted(some))) for some in initials.values())
    assert repair.digest(repair.damage(df.limit(0))).count() == 0 and found.count() == len(want)


def plain_collocations(rows, least, top):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {p: f for p, f in counts.items() if f >= least}
    found = defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        if any(q != p and lang == o and f >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (o, q), f in often.items() if len(q) > len(p)):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((score, a, " ".join(p), left, right))
    out = set()
    for lang, some in found.items():
        some.sort(key=lambda s: (-s[0], -s[1], s[2].encode()))
        out |= {(lang, i + 1, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(some[:top])}
    return out


@pytest.mark.parametrize("cut_up", [False, True])
def test_collocations(spark, monkeypatch, cut_up):
    """Whole texts, also where a piece is cut between slices; few bits, so that buckets are shared; nulls, repeats, an empty table."""
    if cut_up:
        monkeypatch.setattr(phrases, "SLICE", 200)
    rng = random.Random(7)
    words = ["red", "Red", "blau", "é", "x\x00y", "of", "the", "sea", "a", "b"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " "]) for _ in range(rng.randint(0, 120)))
    rows = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(60)] + [("en", None), ("en", ""), ("fr", "one of"), ("en", "of the sea a b " * 60), ("en", "of the sea a b " * 60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int")
    got = {tuple(r) for r in phrases.collocations(df, least=12, top=40, bits=13).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == plain_collocations(rows, 12, 40) and len(got) > 50
    assert phrases.collocations(df.limit(0), bits=13).count() == 0


def test_row_ids_do_not_move(spark, tmp_path):
    """Built while files are split one way and read while they are split another way, no row is lost or joined to another's answer."""
    rows = [(i, f"text {i % 50} " * 40, f"s{i % 3}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "docs"))
    name = "spark.sql.files.minPartitionNum"
    try:
        docs = spark.read.parquet(str(tmp_path / "docs"))
        spark.conf.set(name, "2")
        built = {"exact": exact_dedup.exact_duplicates(docs), "near": jaccard.similar_groups(docs), "mixed": mixing.mix(docs), "repeats": repeats.without_repeats(docs, bits=16, with_text=False)}
        want = {k: sorted(map(str, d.select(sorted(d.columns)).collect())) for k, d in built.items()}
        spark.conf.set(name, "64")
        for k, d in {"exact": exact_dedup.exact_duplicates, "near": jaccard.similar_groups, "mixed": mixing.mix}.items():
            spark.conf.set(name, "2")
            plan = d(spark.read.parquet(str(tmp_path / "docs")))
            spark.conf.set(name, "64")
            got = sorted(map(str, plan.select(sorted(plan.columns)).collect()))
            assert len(got) == 400 and got == want[k], k
    finally:
        spark.conf.unset(name)


def test_queries_registered():
    assert {"op11_suffix_dedup", "op12_conversation_repair", "op13_collocations"} <= set(queries.queries()) & set(queries.oracle_sql())


def test_odds_of_words_need_no_pattern_for_usual_signs(monkeypatch):
    import zlib

    import numpy as np

    from factloom.llm import toxicity

    def named(word):
        w = toxicity._EDGE.sub("", word.lower())
        names = [f"w={w}", f"s3={w[-3:]}", *[f"p{k}={w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k]] if w else ["none"]
        return [zlib.crc32(n.encode()) % toxicity.WEIGHTS for n in names]

    words = ["Plain", "(sign);", "\"It's,", "12a", "_x9", "--", "Élan…", "日本", "ab"]
    want = [named(w) for w in words]
    assert [toxicity._features(w) for w in words] == want
    model = toxicity.Chain(np.random.default_rng(1).normal(size=toxicity.WEIGHTS), -1.0, np.zeros((2, 2)), (0.0, 1.0, 1.0))
    assert np.allclose([model.odds(w) for w in words], [np.exp(np.clip(-1.0 + model.weights[f].sum(), -12, 12)) for f in want])
    monkeypatch.setattr(toxicity, "_EDGE", None)
    assert [toxicity._features(w) for w in words[:2]] == want[:2]


def test_words_outlast_a_chunk_that_lacks_them(monkeypatch):
    from factloom.llm import packing
    from factloom.llm.queries import tokenizer_path

    monkeypatch.setattr(packing, "KEPT", 12)
    encoder = packing.Encoder(tokenizer_path())
    texts = ["one two three four five six seven", "other", "one two three four"]
    asked, plain = [], encoder._words
    monkeypatch.setattr(encoder, "_words", lambda words: asked.append(sorted(words)) or plain(words))
    got = [encoder.encode([t])[0].tolist() for t in texts]
    assert got == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked[1:] == [["other"], []]


def test_words_are_put_together_from_pieces(monkeypatch):
    """Signs behind letters cost no new word; texts with runs of white space, added tokens and other scripts give the library's ids."""
    from factloom.llm import packing
    from factloom.llm.queries import tokenizer_path

    encoder = packing.Encoder(tokenizer_path())
    asked, plain = [], encoder._words
    monkeypatch.setattr(encoder, "_words", lambda words: asked.append(sorted(words)) or plain(words))
    texts = ["one two three.\nFour", " two, three*** four.\nFour", "two  three.\n\nFour \n it's ", "a<|endoftext|>. <|endoftext|>two.", "", " ", "²x. ǅe! ɐ.\nɏ? 中文. _a_ x'll."]
    for t in texts:
        assert encoder.encode([t])[0].tolist() == encoder.library.encode(t, add_special_tokens=False).ids
    assert asked[0] == sorted(["", "one", " two", " three", ".", "\n", "Four"]) and asked[1] == sorted([",", "***", " four"])
    monkeypatch.setattr(packing, "BLOCK", 3)
    rng = np.random.default_rng(5)
    parts = ["one", "Two", " ", " ", "  ", "\n", ".", ",", "'s", "$$", "é", "ß", "12", "<|endoftext|>", "|", " ", "\x1c", "中"]
    many = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(2000)]
    assert [x.tolist() for x in encoder.encode(many)] == [e.ids for e in encoder.library.encode_batch(many, add_special_tokens=False)]
    assert encoder.encode([]) == []


def test_kept_words_are_small():
    """Words that a worker keeps from task to task take a few bytes each beside their letters and ids."""
    import tracemalloc

    from factloom.llm import packing
    from factloom.llm.queries import tokenizer_path

    encoder = packing.Encoder(tokenizer_path())
    encoder.encode(["warm up"])
    text = " ".join(f"{a}{b}{c}{d}" for a in "bcdfghkl" for b in "aeiou" for c in "mnprstvz" for d in ["ba", "do", "li", "ne", "pu", "ra", "so", "ti", "ve", "wu"])
    n = len(set(text.split()))
    tracemalloc.start()
    try:
        encoder.encode([text])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held + getattr(getattr(encoder.kept, "words", None), "nbytes", 0) < 80 * n
