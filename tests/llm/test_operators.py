"""The operators against brute force on small, awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(60)]


def frame(spark, rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
    width = len(columns.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], columns)


def awkward(seed=1):
    """Rows with copies, near copies, repeats within and across rows, nulls, empty and long texts."""
    chance = random.Random(seed)
    prose = lambda n: " ".join(chance.choices(WORDS, k=n))
    passage = prose(70)
    rows = [(i, prose(chance.randint(1, 120))) for i in range(30)]
    rows += [(i, f"{prose(15)} {passage} {prose(9)}") for i in range(30, 38)]
    rows += [(40, passage), (41, passage), (42, f"{passage}\n{passage}"), (43, " ".join(["same"] * 400)), (44, "x" * 900)]
    rows += [(50, None), (51, ""), (52, " \t\n "), (53, "ünï " * 120 + passage), (54, prose(3000)), (55, "a b c d"), (56, "A b C d")]
    base = prose(200).split()
    for i in range(60, 75):
        copy = list(base)
        for _ in range(chance.randint(0, 12)):
            copy[chance.randrange(len(copy))] = chance.choice(WORDS)
        rows.append((i, " ".join(copy)))
    chance.shuffle(rows)
    return rows


def words(text):
    return (text or "").encode().split()


def test_repeated_bytes(spark):
    from stagewise.llm import repeated_bytes as op

    rows = awkward()
    data = {i: (t or "").encode() for i, t in rows}
    seen = {}
    for i, b in data.items():
        for s in range(len(b) - op.LENGTH + 1):
            seen.setdefault(b[s : s + op.LENGTH], []).append((i, s))
    gone = {i: np.zeros(len(b), bool) for i, b in data.items()}
    for found in seen.values():
        if len(found) > 1:
            for i, s in found:
                gone[i][s : s + op.LENGTH] = True
    want = {}
    for i, b in data.items():
        lost = gone[i]
        spans = sum(1 for p in range(len(b)) if lost[p] and (p == 0 or not lost[p - 1]))
        want[i] = (len(b), int(lost.sum()), spans, hashlib.sha256(bytes(x for x, y in zip(b, lost) if not y)).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in op.remove_repeats(frame(spark, rows).repartition(3)).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 5_000


def test_suffix_order_and_prefixes():
    from stagewise.llm import repeated_bytes as op

    chance = np.random.default_rng(3)
    for letters in (2, 5, 255):
        text = np.concatenate([chance.integers(0, letters, 3000).astype(np.uint8), np.zeros(op.LENGTH, np.uint8)])
        text[1000:1600] = text[200:800]
        n = len(text) - op.LENGTH
        order = op.suffix_order(text, np.ones(n, bool))
        rows = [text[i : i + op.LENGTH].tobytes() for i in order]
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
        for i, common in list(enumerate(op.common_prefixes(text, order)))[1:]:
            a, b = rows[i - 1], rows[i]
            assert common == next((j for j in range(op.LENGTH) if a[j] != b[j]), op.LENGTH)


def test_strings_are_sorted_by_their_starts(monkeypatch):
    import tracemalloc

    from stagewise.llm import repeated_bytes as op

    chance = np.random.default_rng(8)
    passage = chance.integers(0, 255, op.LENGTH - 1).astype(np.uint8)
    own = chance.integers(0, 255, (5000, 200)).astype(np.uint8)
    own[::3] = own[0]
    text = np.concatenate([*(x for one in own for x in (passage, one)), np.zeros(op.LENGTH, np.uint8)])
    starts = np.arange(0, len(text) - op.LENGTH, 3)
    want = op.in_order(text, starts[:40_000])
    starts = starts.copy()
    monkeypatch.setattr(op, "COPIED", 1_000)
    assert (op.in_order(text, starts[:40_000]) == want).all()
    tracemalloc.start()
    op.in_order(text, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(starts)  # a copy takes 200 bytes a string


def test_repeated_words(spark):
    from stagewise.llm import repeated_words as op

    rows = awkward(2)
    seen, gone = {}, {i: set() for i, _ in rows}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for s in range(len(w) - op.WINDOW + 1):
            key = tuple(w[s : s + op.WINDOW])
            if key in seen:
                gone[i].update(range(s, s + op.WINDOW))
            seen[key] = True
    want = {}
    for i, t in rows:
        w = words(t)
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone[i])
        want[i] = (len(w), len(gone[i]), hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in op.remove_repeats(frame(spark, rows).repartition(4)).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 500


def shingle_groups(rows):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    group = {i: i for i, _ in rows}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return sets, group


@pytest.mark.parametrize("seed", [3, 4])
def test_near_documents(spark, seed):
    from stagewise.llm.near_text import first_of_each, near_groups

    rows = awkward(seed)
    sets, group = shingle_groups(rows)
    docs = frame(spark, rows).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(docs).collect()}
    assert got == {i: (len(sets[i]), group[i], group[i] == i) for i, _ in rows}
    kept = first_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in group if group[i] == i}


def test_near_documents_compare_all_of_a_key(spark, monkeypatch):
    """A chain of edits: neighbours are similar, most others are not, so one pivot per key can't do."""
    from stagewise.llm.near_text import near_groups

    chance = random.Random(8)
    rows, now = [], chance.choices(WORDS, k=150)
    for i in range(40):
        rows.append((i, " ".join(now)))
        now = list(now)
        now[chance.randrange(150)] = f"n{i}"
    sets, group = shingle_groups(rows)
    got = {r.doc_id: r.component_id for r in near_groups(frame(spark, rows)).collect()}
    assert got == group and set(group.values()) == {0}


def test_near_vectors(spark):
    from stagewise.llm.near_vectors import near_vectors

    chance = np.random.default_rng(2)
    base = chance.normal(size=(60, 16))
    vectors = [*base, *(base[:20] + 0.02 * chance.normal(size=(20, 16))), *([base[3]] * 4), *(base[5] + 0.01 * chance.normal(size=(30, 16)))]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0] * 7), (905, [None] * 16), (906, [float("inf")] * 16)]
    rows += [(907, [1.0] * 7), (908, [2.0] * 7)]
    good = {i: np.array(v) for i, v in rows if i < 900 or i in (904, 907, 908)}
    links = {i: set() for i, _ in rows}
    for a, x in good.items():
        for b, y in good.items():
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a].add(b)
    group = {i: i for i, _ in rows}
    for _ in rows:
        for a in links:
            group[a] = min([group[a], *(group[b] for b in links[a])])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert got == {i: (len(links[i]), group[i], group[i] == i) for i, _ in rows}


@pytest.mark.parametrize("fall", [0.5, 1.0])
def test_near_vectors_probe_all_lists_in_reach(fall):
    from stagewise.llm.near_vectors import Quantiser

    chance = np.random.default_rng(5)
    scale = np.arange(1, 257) ** -fall  # axes of very different spread, as real embeddings have
    x = chance.normal(size=(6000, 256)) * scale
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = chance.normal(size=x.shape) * scale
    y -= (x * y).sum(axis=1, keepdims=True) * x
    cosine = chance.uniform(0.9, 0.93, (len(x), 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    known = Quantiser.fit(x, 200, 0.9)
    _, near = known.probes(x)
    own, _ = known.probes(y)
    assert near[np.arange(len(x)), own].mean() == 1.0


def test_near_vectors_hot_list(spark, monkeypatch):
    from stagewise.llm import near_vectors

    chance = np.random.default_rng(6)
    x = np.concatenate([np.ones((90, 8)) + 0.02 * chance.normal(size=(90, 8)), chance.normal(size=(60, 8))]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    monkeypatch.setattr(near_vectors, "PACK", 16)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(df).collect()}
    assert [got[i][0] for i in range(len(x))] == (linked.sum(axis=1) - 1).tolist()
    assert {got[i][1] for i in range(90)} == {0}


def test_near_vectors_memory_of_a_tight_cluster():
    import tracemalloc

    from stagewise.llm import near_vectors

    chance = np.random.default_rng(7)
    x = np.ones((2 * 2500, 16)) + 0.02 * chance.normal(size=(5000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    known = near_vectors.Quantiser.fit(x, 4, 0.9)
    own = np.sort(near_vectors.nearest(x, known.centres)).astype("<i4")
    x = x[np.argsort(near_vectors.nearest(x, known.centres), kind="stable")]
    codes, errors = known.codes(x, own)
    packs = []
    for a, b in ((0, 2500), (2500, 5000)):
        fields = (np.arange(a, b), np.full(b - a, 2), x[a:b], own[a:b], codes[a:b], errors[a:b])
        packs.append(near_vectors.Pack.of(known, "<f8", *(f.tobytes() for f in fields)))
    tracemalloc.start()
    found = near_vectors.links_between(known, *packs, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000  # all 6.25 million pairs at once take several times as much
    counts = found[found["b"].isna()]
    assert len(counts) == 5000 and set(counts["n"]) == {5000} and found["b"].notna().sum() == 4999


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from stagewise.llm.token_files import read_document, read_token_files, token_ids, train_dictionary, write_token_files
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*awkward(5), (80, "a  b\n\n c\t <|endoftext|> é"), (81, "tab\t\nend \n")]
    want, start = {}, 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    docs = frame(spark, rows).repartition(4)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_ids(docs, path).collect()}
    assert got == want
    manifest = write_token_files(docs, str(tmp_path), path, train_dictionary(docs, path))
    shards = {r.shard: r.path for r in manifest.collect()}
    for r in read_token_files(manifest, str(tmp_path)).limit(9).collect():
        assert read_document(str(tmp_path), shards[r.shard], r.place).tobytes() == bytes(r.ids)


PIECES = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003", "\0", "a", "The", "don't", "'s", "12", "_", "\u00e9t\u00e9", "\u4e2d", "\U0001f600", "<|endoftext|>", ".", "--"]


@pytest.mark.parametrize("weights", [None, [30] + [1] * (len(PIECES) - 1), [9, 0, 2, 0, 0, 0, 0, 0, 0] + [3] * (len(PIECES) - 10) + [0]])
def test_pieces_have_the_ids_of_whole_texts(weights):
    import public_tokenizers
    from stagewise.llm.token_files import PieceIds

    chance = random.Random(8)
    encoder = PieceIds(public_tokenizers.path("byte_bpe_50k.json"), most=150)
    if weights:
        weights = (weights + [1] * len(PIECES))[: len(PIECES)]
    texts = ["".join(chance.choices(PIECES, weights, k=chance.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", " ", "\n", "x " * 50_000, " " * 50_000, "-" * 20_000, "word " * 1_000_000, "\n \n" * 9_000]
    for a in range(0, len(texts), 100):
        some = texts[a : a + 100]
        assert encoder.encode(some) == [encoder.whole(text or "") + b"\0\0\0\0" for text in some]
    assert len(encoder.known) + len(encoder.older) < 100_000


def test_tasks_do_not_carry_what_the_driver_remembers(spark, tmp_path, monkeypatch):
    """op10_token_files: the function that reads shards took the driver's pieces along to every task."""
    import public_tokenizers
    from pyspark import cloudpickle
    from pyspark.sql import DataFrame
    from stagewise.llm.token_files import pieces_of, read_token_files, write_token_files

    path, sent = public_tokenizers.path("byte_bpe_50k.json"), []
    pieces_of(path).encode([" ".join(f"x{i}" for i in range(5_000))])
    docs = frame(spark, [(i, f"text {i}") for i in range(20)])
    original = type(docs).mapInPandas
    monkeypatch.setattr(type(docs), "mapInPandas", lambda df, f, *rest: sent.append(f) or original(df, f, *rest))
    manifest = write_token_files(docs, str(tmp_path), path, b"")
    assert isinstance(docs, DataFrame) and read_token_files(manifest, str(tmp_path), digest=True).count() == 20
    assert len(sent) == 2 and all(len(cloudpickle.dumps(f)) < 50_000 for f in sent)


def test_a_batch_mixes_texts_cut_in_all_ways():
    """Null, empty, plain texts, those with empty lines, null characters, blanks at a cut and special tokens side by side."""
    import public_tokenizers
    from stagewise.llm.token_files import PieceIds

    encoder = PieceIds(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "a b\nc", "a\n\nb c", "a\0b c", "a  b \n c", "x <|endoftext|> y", " ", "\n", "d\r\n e\u2003 f", "a b\nc", "\u4e2d \u00e9t\u00e9 don't"]
    for some in (texts, texts[::-1], [None, ""], [], ["\n\n"], ["a b"]):
        assert encoder.encode(some) == [encoder.whole(text or "") + b"\0\0\0\0" for text in some]


def test_many_texts_of_one_id_are_spread(spark, tmp_path, monkeypatch):
    import public_tokenizers
    from stagewise.llm import token_files
    from stagewise.llm.token_files import read_token_files, write_token_files

    monkeypatch.setattr(token_files, "ROWS_OF_AN_ID", 100)

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = frame(spark, [(i if i % 3 else 7, f"text {i} " * (i % 40)) for i in range(1500)]).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = write_token_files(docs, str(tmp_path), path, b"")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == 1500 and max(sizes) < 500
    ids = [r.doc_id for r in read_token_files(manifest, str(tmp_path)).orderBy("shard", "place").collect()]
    assert ids == sorted(ids)


def test_mixing(spark):
    from stagewise.llm.mixing import MOST, SHARE, WEIGHTS, mix, mixed

    chance = random.Random(4)
    sources = {"a": 1500, "b": 30, "ç": 9000, None: 400, "z": 20}
    rows, n = [], 0
    for source, count in sources.items():
        for _ in range(count):
            rows.append((n, " ".join(["w"] * chance.randint(0, 40)), None, source))
            n += 1
    docs = frame(spark, rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = SHARE * sum(sizes.values()) - sum(MOST * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: MOST * sizes[s] if s in full else weight[s] * left / open_weight for s in names}
        above = {s for s in names if s not in full and target[s] > MOST * sizes[s]}
        if not above:
            break
        full |= above
    first = mix(docs, ["doc_id", "source"]).select("row.*", "size", "source_size", "target", "taken", "copies").collect()
    again = mix(docs.repartition(7), ["doc_id", "source"]).select("row.*", "size", "source_size", "target", "taken", "copies").collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str) and len(first) == len(rows)
    taken, picked = {}, {}
    for r in first:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        picked[r.source] = picked.get(r.source, 0) + r.copies
    for s, count in sources.items():
        assert abs(taken[s] - target[s]) <= 60
        assert abs(picked[s] - count * target[s] / sizes[s]) <= 4
    out = mixed(docs)
    assert out.columns == docs.columns
    double = mixed(docs.union(docs).union(docs.withColumn("lang", F.lit("zz"))))
    again = mix(docs.union(docs).union(docs.withColumn("lang", F.lit("zz"))), ["doc_id", "lang"]).groupBy("row.doc_id", "row.lang").agg(F.sum("copies").alias("n"))
    counts = {(r.doc_id, r.lang): r.n for r in double.groupBy("doc_id", "lang").agg(F.count("*").alias("n")).collect()}
    assert counts == {(r.doc_id, r.lang): r.n for r in again.collect() if r.n}
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {r.doc_id: r.copies for r in first if r.copies}


def edits(item, text):
    """Fewest edits of the whole item against any part of a text."""
    row = np.zeros(len(text) + 1, int)
    for i, letter in enumerate(item, 1):
        step = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + np.array([letter != x for x in text], int))])
        row = np.minimum.accumulate(step - np.arange(len(step))) + np.arange(len(step))
    return int(row.min())


def test_decontamination(spark):
    from stagewise.llm.decontaminate import budget_of, leaks_in, normal, without_leaks

    chance = random.Random(6)
    letters = "abcdefghij "
    prose = lambda n: "".join(chance.choices(letters, k=n))
    items = [(i, prose(chance.randint(60, 200))) for i in range(6)] + [(6, "short"), (7, None), (None, prose(80)), (8, prose(30) + " é日本" + prose(30))]
    rows = [(i, prose(300)) for i in range(6)] + [(90, None), (91, ""), (92, "tiny")]
    for i, (item, text) in enumerate([x for x in items if x[1] and len(x[1]) > 20] * 8):
        changed = list(text)
        for _ in range(chance.randint(0, int(0.13 * len(text)))):
            at = chance.randrange(len(changed))
            changed[at : at + 1] = chance.choice([[], [chance.choice(letters)], [changed[at], chance.choice(letters)]])
        rows.append((100 + i, prose(chance.randint(0, 90)) + "".join(changed).upper() + "  " + prose(chance.randint(0, 90))))
    want = {}
    for i, t in rows:
        for item, text in items:
            if t and text and item is not None and normal(text):
                n = edits(normal(text), normal(t))
                if n <= budget_of(len(normal(text))):
                    want[i, item] = n
    docs, benchmark = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in leaks_in(docs, benchmark).collect()}
    assert set(got) == set(want) and all(want[k] <= got[k] for k in want)
    clean = without_leaks(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}


@pytest.mark.parametrize("limits", [(65_536, 262_144, 2_000_000), (64, 40, 100), (64, 0, 100)])
def test_items_of_any_length_have_their_full_budget(limits, monkeypatch):
    from stagewise.llm import decontaminate as op

    for name, value in zip(("STRETCH", "MOST_PAIRS", "PAIRS_AT_ONCE"), limits):
        monkeypatch.setattr(op, name, value)
    chance = random.Random(7)
    prose = lambda n, letters="abcdef ": "".join(chance.choices(letters, k=n))
    items = [(n, op.normal(prose(n, "abcdefghijklm ") + "z")) for n in range(2, 45)]
    items += [(100, "-" * 33), (101, "-=" * 20), (102, "----+" * 9), (103, "-" * 30 + "x"), (104, "caf\u00e9 \u65e5\u672c" * 6), (105, " \n "), (106, "")]
    index = op.ItemIndex.of(items)
    texts = ["", "-", "-" * 700, "=-" * 300 + "x", "----+" * 100, "--- " * 200, prose(500)]
    for _ in range(90):
        text = prose(chance.randint(0, 200))
        for item in chance.sample(items, 3):
            changed = list(item[1])
            for _ in range(chance.randint(0, max(1, len(changed) // 9))):
                if changed:
                    at = chance.randrange(len(changed))
                    changed[at : at + 1] = chance.choice([[], ["q"], [changed[at], "q"]])
            text += "".join(changed) + prose(chance.randint(0, 90))
        texts.append(text)
    for text in texts:
        want = {}
        for i, item in items:
            if item.strip():
                n = edits(item, op.normal(text))
                if n <= len(item) // 10:
                    want[i] = n
        got = {i: (a, b, n) for i, a, b, n in index.leaks(text)}
        assert set(got) == set(want)
        for i, (a, b, n) in got.items():
            assert n >= want[i] and (n > 0 or op.normal(text)[a:b] == dict(items)[i])


def test_long_uniform_texts_need_little_memory():
    import time
    import tracemalloc

    from stagewise.llm import decontaminate as op

    index = op.ItemIndex.of([(1, "-" * 200), (2, "=" * 30 + "x" + "=" * 60), (3, "an item of words that does not occur in there")])
    text = "-" * 2_500_000 + "=" * 2_500_000
    tracemalloc.start()
    began = time.process_time()
    got = index.leaks(text)
    took, (_, peak) = time.process_time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [(i, n) for i, _, _, n in got] == [(1, 0), (2, 1)]
    assert took < 30 and peak < 200_000_000


def test_language(spark):
    from stagewise.llm.language import UNKNOWN, identify, known_language

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = docs.limit(1).selectExpr("-1L AS doc_id", "cast(null AS string) AS text", "'en' AS lang", "source", "n_chars")
    odd = odd.union(odd.selectExpr("-2L", "'12 !! 3'", "lang", "source", "n_chars")).union(odd.selectExpr("-3L", "''", "lang", "source", "n_chars"))
    rows = identify(docs.union(odd)).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id >= 0]
    assert len(held) > 250 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all((r.lang_pred, r.score) == (UNKNOWN, 0.0) for r in rows if r.doc_id < 0)
    assert all(0 <= r.score <= 1 for r in rows)
    kept = known_language(docs.union(odd))
    assert kept.columns == docs.columns and 0.99 * docs.count() < kept.count() <= docs.count()


def test_language_is_the_one_that_compresses_best(spark):
    import re

    import zstandard
    from stagewise.llm import language as op

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    learned = op.learn_dictionaries(docs.filter(~F.col("doc_id").isin(list(held))))
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = {lang: " ".join(re.sub(r"[\W\d_]+", " ", r.text.lower()) for r in docs.filter(F.col("lang") == lang).collect()) for lang in learned}
    for lang, data in learned.items():
        words = data.decode("utf-8", "ignore").split()
        assert len(words) > 300 and sum(w in whole[lang] for w in words) == len(words)
    presses = {
        lang: zstandard.ZstdCompressor(
            level=op.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False
        )
        for lang, data in learned.items()
    }
    got = {r.doc_id: r for r in op.identify(docs).collect()}
    assert {i for i, r in got.items() if r.held_out} == held
    for i, text in texts.items():
        data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        sums = {lang: sum(len(p.compress(data[a : a + 2048])) for a in range(0, len(data), 2048)) for lang, p in presses.items()}
        best, second = sorted(sums.values())[:2]
        assert sums[got[i].lang_pred] == best and got[i].score == pytest.approx(1 - best / second, abs=1e-12)


def test_all_of_a_passage_is_used(spark):
    from stagewise.llm import language as op

    rows = [(i, "a" * 3000 + f" only {i} " + "b" * 50_000, "aa") for i in range(400)] + [(1000 + i, f"kurz {'y' * i}", "bb") for i in range(9)]
    learned = op.learn_dictionaries(frame(spark, rows))
    assert list(learned) == ["aa", "bb"]
    assert op.PASSAGES * op.PASSAGE_CHARS * 0.9 < len(learned["aa"]) <= op.PASSAGES * (op.PASSAGE_CHARS + 1)
    assert learned["aa"].count(b"b") > learned["aa"].count(b"a")
    assert all(b"kurz" in learned["bb"] and b"y" * i in learned["bb"] for i in range(9))


def test_samples_are_bounded_by_rows(spark):
    from stagewise.llm.samples import labelled_sample

    docs = frame(spark, [(i if i < 50 else 7, f"t{i}") for i in range(5000)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = labelled_sample(docs, labels, "quality", F.lit(True), {0: 10, 1: 12}).collect()
    assert sorted(r.label for r in got) == [0] * 10 + [1] * 12


def test_toxicity_of_copies_of_one_text(spark):
    from stagewise.llm.toxicity import HELD_OUT, _spans, score_toxicity

    chance = random.Random(3)
    bad = "you vile grobnik! " * 6
    rows = [(i, bad if i % 10 == 0 else " ".join(chance.choices(WORDS, k=30))) for i in range(2000)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(2000)], "doc_id long, quality int, toxic int")
    got = score_toxicity(frame(spark, rows), labels).collect()
    assert all(r.predicted == (r.doc_id % 10 == 0) for r in got) and HELD_OUT == 2
    assert _spans({(c, p): 1 for c in (0, 1) for p in range(10)}) == ([0, 1, 2, 3], [4, 5, 6, 7], [8, 9])
    assert _spans({(0, p): 1 for p in range(10)} | {(1, p): 1 for p in range(8)}) == ([0, 1, 2, 3], [4, 5, 6, 7], [4, 5, 6, 7])
    assert _spans({(0, p): 1 for p in range(10)} | {(1, 9): 1})[0] == list(range(10))


def test_risk_takes_back_what_is_overfitted():
    from stagewise.llm.quality import Scorer, estimated_prior

    chance = np.random.default_rng(4)
    good, bad = chance.normal(1.0, 0.5, (3000, 3)), chance.normal(-1.0, 0.5, (3000, 3))
    for share in (0.2, 0.5, 0.8):
        n = int(2000 * share)
        mixed = np.concatenate([good[1000 : 1000 + n], bad[: 2000 - n]])
        assert abs(estimated_prior(good[:1000], mixed) - share) < 0.08
    mixed = np.concatenate([good[1000:1600], bad[:1400]])
    scorer = Scorer(3).fit(good[:1000], mixed, 0.3)
    assert (scorer.margins(good[2000:]) > 0).mean() > 0.97 and (scorer.margins(bad[2000:]) < 0).mean() > 0.97
    # With five positives that are all among few unlabelled rows the risk of the negatives would turn below zero without its bound.
    few = Scorer(3).fit(good[:5], np.concatenate([good[:5], bad[:5]]), 0.5)
    x = np.concatenate([good[:5], bad[:5]])
    rest = np.logaddexp(0, few.margins(x)).mean() - 0.5 * np.logaddexp(0, few.margins(good[:5])).mean()
    assert rest > -0.05


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_classifiers(spark, label):
    from stagewise.llm.quality import score_quality
    from stagewise.llm.toxicity import score_toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.limit(1).selectExpr("-1L AS doc_id", "cast(null AS string) AS text", "lang", "source", "n_chars")
    odd = odd.union(odd.selectExpr("-2L", "''", "lang", "source", "n_chars"))
    rows = (score_toxicity if label == "toxic" else score_quality)(docs.union(odd), labels).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    good = [r.score for r in held if truth[r.doc_id]]
    bad = [r.score for r in held if not truth[r.doc_id]]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([r.predicted == truth[r.doc_id] for r in held])
    print(label, "held out", len(held), "auc", auc, "right", right)
    assert auc > 0.95 and right > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows) and len(rows) == docs.count() + 2


def test_toxicity_counts_letters_alike_at_every_length():
    from stagewise.llm.toxicity import features_of

    short, long = (features_of("so it goes!! 12,34 " * n, {}) for n in (10, 100))
    assert short[9:11] == long[9:11]


def test_empty_tables(spark):
    import public_tokenizers
    from stagewise.llm import decontaminate, language, mixing, near_text, near_vectors, quality, repeated_bytes, repeated_words, token_files, toxicity

    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    results = [
        repeated_bytes.remove_repeats(docs),
        repeated_words.remove_repeats(docs),
        near_text.near_groups(docs),
        near_vectors.near_vectors(vectors),
        decontaminate.leaks_in(docs, benchmark),
        mixing.mix(docs),
        language.identify(docs),
        quality.score_quality(docs, labels),
        toxicity.score_toxicity(docs, labels),
        token_files.token_ids(docs, public_tokenizers.path("byte_bpe_50k.json")),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    import public_tokenizers
    from stagewise.llm import decontaminate, language, mixing, near_text, quality, repeated_bytes, repeated_words, token_files, toxicity

    rows = [(1, "one two three " * 80), (1, "one two three " * 80), (None, "x y z"), (None, None), (2, "other words here " * 90)] * 2
    extra = "row long, part double, size long, bucket long, score double, label int, block long, features string, h long, `a.b` string"
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "nothing of the kind in here at all")], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out in (
        repeated_bytes.remove_repeats(docs),
        repeated_words.remove_repeats(docs),
        near_text.near_groups(docs),
        mixing.mix(docs),
        language.identify(docs),
        quality.score_quality(docs, labels),
        toxicity.score_toxicity(docs, labels),
        token_files.token_ids(docs, path),
    ):
        assert out.count() == len(rows)
    assert decontaminate.leaks_in(docs, benchmark).count() == 0
    for out in (decontaminate.without_leaks(docs, benchmark), near_text.first_of_each(docs), mixing.mixed(docs), language.known_language(docs)):
        assert out.columns == docs.columns
        out.collect()
    assert near_text.first_of_each(docs).count() == 5  # three texts, and two rows without words


def test_scratch_deletes_what_is_not_kept(spark):
    from stagewise.llm.tables import _folders, scratch, stored

    rows = spark.range(3)
    with scratch() as outer:
        with scratch() as inner:
            gone, kept = stored(rows, "gone"), inner.keep(stored(rows, "kept"))
            paths = [_folders[id(x)] for x in (gone, kept)]
        assert kept.count() == 3
        last = outer.keep(stored(rows, "last"))
    assert last.count() == 3
    fs = spark._jvm.org.apache.hadoop.fs
    there = [fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs.Path(p)) for p in [*paths, _folders[id(last)]]]
    assert there == [False, False, True]
