"""Lattice neighbours, token alignment and vector codes against brute force."""

import hashlib
import importlib.util
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from panelkiln.llm import alignment, common, hamerly_codes, lattice_neighbours
from panelkiln.llm.pieces import BYTE
from panelkiln.llm.queries import vocabulary

needs_vocabulary = pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="no vocabulary files here")
VECTORS = "vec_id long, embedding array<float>, label int, item long, ball long, cell string, key string, own string, q string, n string"


def vectors(spark, rows):
    common.prepare(spark)
    return spark.createDataFrame([(i, v, label, 1, 2, *"abcde") for i, v, label in rows], VECTORS).repartition(3)


def as_list(v):
    return [float(x) for x in v]


def turned(rng, v, cos):
    g = rng.normal(size=len(v))
    g -= g @ v * v
    return cos * v + np.sqrt(1 - cos * cos) * g / np.linalg.norm(g)


def unit(rng, n=64):
    v = rng.normal(size=n)
    return v / np.linalg.norm(v)


def linked(rows, threshold=0.9):
    """{position: (links, component)} by all pairs."""
    usable = [k for k, (_, v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    for a, k in enumerate(usable):
        x = np.array(rows[k][1], np.float32).astype(float)
        for j in usable[a + 1 :]:
            y = np.array(rows[j][1], np.float32).astype(float)
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                near[k].add(j)
                near[j].add(k)
    out = {}
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[k] = (len(near[k]), min(ids) if ids else None)
    return out


def hard_vectors():
    rng = np.random.default_rng(3)
    base = [unit(rng) for _ in range(30)]
    out = [(10 * i, v) for i, v in enumerate(base)]
    out += [(1000 + i, turned(rng, base[i % 10], c)) for i, c in enumerate(np.linspace(0.89, 0.999, 60))]
    tight, loose = unit(rng), unit(rng)
    out += [(2000 + i, turned(rng, tight, 0.997)) for i in range(80)]  # one ball
    out += [(3000 + i, turned(rng, loose, 0.96)) for i in range(60)]  # linked or not, pair by pair
    out += [(4000 + i, turned(rng, turned(rng, tight, 0.92), 0.999)) for i in range(20)]  # near the ball's reach
    rows = [(i, as_list(v), i % 3) for i, v in out]
    rows += [(5000 + i, rows[0][1], None) for i in range(70)] + [(6000, [7 * x for x in rows[5][1]], 0), (None, rows[6][1], 0), (None, as_list(unit(rng)), 0), (10, rows[1][1], 1), (10, rows[1][1], 1)]
    rows += [(7000, None, 1), (7001, [], 1), (7002, [0.0] * 64, 1), (7003, [None] + [1.0] * 63, 1), (7004, [float("nan")] * 64, 1), (7005, [float("inf")] + [0.0] * 63, 1), (None, None, 1), (7006, [1.0, 2.0], 0), (7007, [1.0, 2.01], 0)]
    return rows


def test_lattice_links_equal_all_pairs(spark):
    rows = hard_vectors()
    want = linked(rows)
    got = lattice_neighbours.embedding_groups(vectors(spark, rows)).collect()
    have = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    expected = Counter((rows[k][0], n, c) for k, (n, c) in want.items())
    # Every pair that is found is a link; few links at the threshold may be missed.
    missed = sum((expected - have).values())
    assert len(got) == len(rows) and missed <= 0.02 * len(rows), (expected - have, have - expected)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert sum(r["n_links"] for r in got) >= 0.995 * sum(n for n, _ in want.values())
    assert sum(r["n_links"] for r in got) <= sum(n for n, _ in want.values())


def test_lattice_recall_and_points():
    rng = np.random.default_rng(8)
    for cos, least in ((0.9, 0.97), (0.92, 0.985), (0.95, 0.998)):
        a = np.stack([unit(rng) for _ in range(1500)])
        b = np.stack([turned(rng, x, cos) for x in a])
        x, y = lattice_neighbours.keys(a), lattice_neighbours.keys(b)
        assert (x[:, :, None] == y[:, None, :]).any((1, 2)).mean() >= least
        assert (lattice_neighbours._apart(lattice_neighbours.signs(a), lattice_neighbours.signs(b)) <= lattice_neighbours.most_bits(np.arccos(cos))).all()
    # The decoded point is the nearest of all lattice points around it, and sums are even.
    x = rng.normal(size=(300, 8)) * 3
    own = lattice_neighbours.decoded(x)
    assert (np.rint(own.sum(1)) % 2 == 0).all() and (np.rint(2 * own) == 2 * own).all()
    others = ((x[:, None] - own[:, None] - lattice_neighbours.around()) ** 2).sum(2)
    assert (((x - own) ** 2).sum(1) <= others.min(1) + 1e-9).all() and ((x - own) ** 2).sum(1).max() <= 1 + 1e-9


def test_balls_are_counted_not_paired(spark):
    """300 vectors of one tight group: few balls, few links between them, every vector linked with all others."""
    rng = np.random.default_rng(5)
    centre = unit(rng)
    df = vectors(spark, [(i, as_list(turned(rng, centre, 0.9985)), 0) for i in range(300)])
    written = []
    old = lattice_neighbours.written
    lattice_neighbours.written = lambda d, name: written.append((name, out := old(d, name))) or out
    try:
        got = lattice_neighbours.embedding_groups(df).collect()
    finally:
        lattice_neighbours.written = old
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)}
    made = dict(written)
    assert made["totals"].count() < 40 and made["ball-links"].count() < 600 and made["met"].count() < 3000


def test_lattice_empty(spark):
    assert lattice_neighbours.embedding_groups(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in lattice_neighbours.embedding_groups(vectors(spark, [(3, None, 1)])).collect()] == [(3, 0, 3, True)]


def coded(rows):
    """Lloyd's rounds by full scans over the kept rows: ({row: code}, errors, codebooks' digest)."""
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = np.floor(1024 * np.array([r[1] for r in kept], np.float32).astype(float)).astype(np.int64)
    parts = q.reshape(len(q), 4, -1)
    books = [parts[:256, p].copy() for p in range(4)]
    for step in range(5):
        d = [((parts[:, p, None] - books[p]) ** 2).sum(2) for p in range(4)]
        own = np.stack([x.argmin(1) for x in d], 1)
        if step < 4:
            for p in range(4):
                for k in set(own[:, p].tolist()):
                    books[p][k] = parts[own[:, p] == k, p].sum(0) // int((own[:, p] == k).sum())
    error = sum(x.min(1) for x in d)
    total = Counter()
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return Counter((i, "".join(f"{x:02x}" for x in o), e, total[label], digest) for (i, _, label), o, e in zip(kept, own.tolist(), error.tolist(), strict=True))


@pytest.mark.parametrize("scale", [1.0, 0.02, 40000.0])
def test_codes_equal_full_scans(spark, scale):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(120, 16)) * scale
    rows = [(int(i), as_list(np.float32(base[rng.integers(120)] + rng.normal(size=16) * scale * (k % 4) / 8)), None if k % 7 == 0 else k % 5) for k, i in enumerate(rng.permutation(700))]
    rows += [(701, rows[3][1], 2), (701, rows[3][1], 2), (None, rows[9][1], 2), (702, None, 1), (703, [], 1), (704, [None] * 16, 1), (705, [float("nan")] * 16, 1), (706, [float("-inf")] * 16, 1)]
    got = hamerly_codes.vector_codes(vectors(spark, rows)).collect()
    assert Counter(map(tuple, got)) == coded(rows)


def test_codes_of_few_and_no_vectors(spark):
    rows = [(4, [0.5, 1.0, -0.25, 3.0], None), (2, [0.5, 1.0, -0.25, 3.0], 1), (9, [1.5, 1.0, 0.0, 3.0], 1)]
    assert Counter(map(tuple, hamerly_codes.vector_codes(vectors(spark, rows)).collect())) == coded(rows)
    assert hamerly_codes.vector_codes(vectors(spark, [(1, None, 1)])).collect() == []
    with pytest.raises(ValueError):
        hamerly_codes.vector_codes(vectors(spark, [(1, [1.0] * 6, 1)]))


def test_bounds_decide():
    """Bounds spare most scans, never a needed one; ties go to the lower index."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(4000, 8)) * 40)
    old = x[:64].copy()
    old[7] = old[3]
    new = old + np.round(rng.normal(size=old.shape))
    new[9] = new[5]
    own, upper, lower = hamerly_codes.scan(x, old)
    before = own.copy()
    scans = hamerly_codes.Step(old, new).assign(x, own, upper, lower)
    want, _, _ = hamerly_codes.scan(x, new)
    assert np.array_equal(own, want) and not np.array_equal(own, before) and scans < len(x)
    d = np.sqrt(hamerly_codes.squares(x, new))
    near = d[np.arange(len(x)), own]
    d[np.arange(len(x)), own] = np.inf
    assert (upper >= near - 1e-6).all() and (lower <= d.min(1) + 1e-6).all()


def aligned(texts):
    """The contract's columns by a plain two-pointer walk over the libraries' ids."""
    import sentencepiece
    from tokenizers import Tokenizer

    from panelkiln.llm.tokens import byte_letters

    a_side = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    names, back = {i: t for t, i in a_side.get_vocab().items()}, {c: b for b, c in byte_letters().items()}
    b_bytes = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for i, t in texts:
        t = t or ""
        a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
        a_ends, b_ends = np.cumsum([sum(c in back for c in names[x]) for x in a]), np.cumsum([len(b_bytes(x)) for x in b])
        if not t or b"".join(map(b_bytes, b)) != (" " + t).encode():
            found.append((i, 0, 0, [], ""))
            continue
        links, groups, x, y, from_x, from_y = [], [], 0, 0, 0, 0
        while x < len(a):
            if a_ends[x] == b_ends[y]:
                links.append((a[x], b[y]))
                groups.append(",".join(map(str, a[from_x : x + 1])) + "|" + ",".join(map(str, b[from_y : y + 1])))
                x, y = x + 1, y + 1
                from_x, from_y = x, y
            elif a_ends[x] < b_ends[y]:
                x += 1
            else:
                y += 1
        counts.update(links)
        found.append((i, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, b), c in counts.items():
        top[b] = max(top[b], c)
    return Counter((i, n_a, n_b, len(links), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha) for i, n_a, n_b, links, sha in found)


@needs_vocabulary
def test_alignment_equals_a_plain_walk(spark):
    common.prepare(spark)
    texts = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    texts += [(-1, None), (-2, ""), (-3, "a ▁ b"), (-4, "<|endoftext|> and <s> and </s> <unk> <0x41>"), (-5, " two  blanks \t\n end "), (-6, "日本語 \U0001f600é" * 50), (-7, "x" * 5000), (-8, "word " * 4000), (-9, "\x00 nul"), (-10, " "), (None, texts[0][1]), (0, texts[0][1]), (5, texts[0][1])]
    df = spark.createDataFrame([(i, t, "p", "q", "r", 1) for i, t in texts], "doc_id long, text string, block string, pairs string, pair string, n_links int").repartition(3)
    got = alignment.alignment_report(df, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.select(columns).collect())) == aligned(texts)
    assert alignment.alignment_report(df.limit(0), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect() == []
    assert BYTE == 6


def test_blocks_are_written_in_small_row_groups(spark, monkeypatch):
    """blocks of some MB are not held by the writer until there are 100 of them."""

    class Stop(Exception):
        pass

    def stop(blocks):
        raise Stop(blocks)

    common.prepare(spark)
    wide = spark.range(0, 40, 1, 1).selectExpr(
        "id as block", "array(id) as doc_id", *(f"array(id) as {c}" for c in alignment.COUNTS), "array('') as groups_sha256", "cast(randstr(1000000, 7) as binary) as pairs"
    )
    monkeypatch.setattr(alignment, "align", lambda *_: wide)
    monkeypatch.setattr(alignment, "pairs_of", stop)
    with pytest.raises(Stop) as stopped:
        alignment.alignment_report(wide, "", "")
    blocks = stopped.value.args[0]
    groups = [f.row_group(i) for f in (pq.ParquetFile(p.removeprefix("file://")).metadata for p in blocks.inputFiles()) for i in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == blocks.count() == 40
    assert max(g.total_byte_size for g in groups) < 12 << 20


@needs_vocabulary
def test_alignment_encodes_units_once(monkeypatch):
    """units that a worker has met don't go to the libraries again, and what a text is cut into doesn't show in its groups."""
    both = alignment.Sides(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    went, encode = [], both.b.encode
    monkeypatch.setattr(both.b, "encode", lambda texts, **options: went.extend(texts) or encode(texts, **options))
    random = np.random.default_rng(3)
    parts = [" ", " ", "\n", "\n", "\t", "a", "The", "'s", "'", ".", ",", "(", "12", "²", "é", "日本", "\xa0", "_", "\x00", "  ", "<s>", "▁"]
    texts = ["It's said, that words\nrepeat; they do."] * 500 + ["".join(random.choice(parts, random.integers(1, 20))) for _ in range(2000)]
    found = list(both.align([t.encode() for t in texts]))
    assert both.cuts and sum(map(len, went)) < sum(map(len, texts)) / 2
    got = Counter((i, n_a, n_b, len(links) // 8, hashlib.sha256(groups).hexdigest() if n_a else "") for i, (groups, links, n_a, n_b) in enumerate(found))
    assert got == Counter((x[0], x[1], x[2], x[3], x[7]) for x in aligned(enumerate(texts)))
