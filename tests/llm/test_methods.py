"""That the operators go the way they say: discounts, batches through the index, run samples, postings, stored transforms."""

import base64
import hashlib
import importlib.util
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from panelkiln.llm import common, digest_dedup, fm_quality, katz, packing, rindex_dedup, secrets, simhash, token_store, tokens, webp
from panelkiln.llm.queries import vocabulary

pytestmark = pytest.mark.skipif(importlib.util.find_spec("public_tokenizers") is None, reason="no vocabulary files here")

SF = "/root/testdata/sf0.01"


def test_good_turing_discounts_hold_on_the_tables(spark):
    """Both orders are discounted by Good-Turing with the largest proper K, and by its formula."""
    c, pairs = Counter(), Counter()
    for i, x in ((r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            words = [*(x or "").encode().lower().split(), b"\n"]
            c.update(words)
            pairs.update(zip([None, *words], words, strict=False))
    for seen in (c, pairs):
        by = Counter(seen.values())
        n = [by.get(r, 0) for r in range(7)]
        d = katz.Discounts.of(n)
        assert d.source == "good-turing" and d.k >= 3
        common_part = (d.k + 1) * n[d.k + 1] / n[1]
        for r in range(1, d.k + 1):
            assert abs(d.d[r] - ((r + 1) * n[r + 1] / n[r] / r - common_part) / (1 - common_part)) < 1e-12
        assert d.d[d.k + 1 :] == (1.0,) * (5 - d.k)


def test_discounts_of_disturbed_counts():
    assert katz.Discounts.of([0, 100, 40, 22, 14, 10, 7]).k == 5
    assert katz.Discounts.of([0, 100, 40, 22, 0, 10, 7]).k == 2
    rough = katz.Discounts.of([0, 100, 60, 5, 30, 1, 9])
    assert rough.source == "smoothed" and all(0 < x < 1 for x in rough.d[1:])
    assert katz.Discounts.of([0, 8, 0, 0, 0, 0, 0]).source == "half" and katz.Discounts.of([0] * 7).source == "half"


def test_any_number_of_batches_gives_one_index(spark):
    """Later copies that are longer or have smaller ids take over, group sizes add up, and nothing is left behind."""
    rows = [(i, t) for i, t in enumerate(["aa", "b", "c c", "a a", " a a ", "cc", "", None, " ", "b", "dd", "a\ta  "] * 7)] + [(3, "b"), (None, "e"), (None, " e ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = None
    for batches in (1, 2, 3, 5):
        since = len(common._made)
        got = sorted(map(tuple, digest_dedup.exact_groups(df, batches=batches).collect()), key=repr)
        want = want or got
        assert got == want
        common.release(since)
    index = digest_dedup.DigestIndex(spark, buckets=3)
    for text in ("aa", "a a ", "aa"):
        index.append(digest_dedup.digests(spark.createDataFrame([(9 - len(text), text)], "doc_id long, text string")))
    row = index.entries().first()
    assert (row["keep_id"], row["keep_chars"], row["group_size"]) == (5, 4, 3) and index.table().count() == 1
    index.drop()


def test_the_query_goes_through_the_anti_join(spark, monkeypatch):
    plans = []
    fresh = digest_dedup.DigestIndex.fresh

    def seen(self, groups):
        out = fresh(self, groups)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(digest_dedup.DigestIndex, "fresh", seen)
    digest_dedup.exact_groups(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert len(plans) == 1 and re.search(r"SortMergeJoin.*LeftAnti", plans[0]) and "Exchange" not in plans[0]


def test_queries_leave_one_folder_each(spark):
    from panelkiln.llm import queries

    for name, query in queries.queries().items():
        before, tables = len(common._made), {t.name for t in spark.catalog.listTables()}
        assert query(spark, "/root/testdata/sf0.001").count() > 0
        left = [x for x in common._made[before:]]
        assert len(left) <= 1 and all(kind == "folder" for kind, _, _ in left), name
        assert {t.name for t in spark.catalog.listTables()} == tables
        common.release(before)
        assert len(common._made) == before


def test_lookup_goes_by_ranges(spark):
    """Every document of a repeated or null id is found, no list of keys is read, absent ids give nothing."""
    path = common.shared_folder(spark, "t")
    texts = [(None if i % 2 else i % 40, f"text number {i} " * (i % 5)) for i in range(300)] + [(5000 + i, "far away") for i in range(0, 60, 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    token_store.write_tokens(df, path, vocabulary("byte_bpe_50k.json"), 2, shard_bytes=400)
    library = tokens.bpe(vocabulary("byte_bpe_50k.json")).tokenizer
    asked = [None, 4, 8, 38, 5003, 5004, 41, -1, 10**12]
    got = token_store.lookup(spark, path, spark.createDataFrame([(x,) for x in asked], "doc_id long"))
    want = Counter((i, (*library.encode(t, add_special_tokens=False).ids, 2)) for i, t in texts if i in asked)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got.collect()) == want and sum(want.values()) > 40
    assert "keys:array" not in got._jdf.queryExecution().executedPlan().toString()
    assert spark.read.parquet(path).where("nulls").select("part").distinct().count() > 1
    # A wrong fingerprint is no match: the stored one decides.
    blob = bytearray(token_store.encode_shard([1, 2, 3], [b"ab", b"cd", b"ef"], 2))
    assert len(list(token_store.Shard(bytes(blob)).find_all([1, 2, 3, 4]))) == 3
    held = token_store.Shard(bytes(blob))
    at = len(blob) - 6 - held.slots.nbytes
    blob[at : at + 8] = bytes(8)
    assert len(list(token_store.Shard(bytes(blob)).find_all([1, 2, 3, 4]))) == 2


@pytest.mark.parametrize("size", [7, 128, 200, 1024])
def test_pieces_equal_the_library(spark, size):
    """start, length, doc_tokens and ids_crc32 of each piece against the library's own ids; each id in exactly one piece."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect() + [(-1, None), (-2, ""), (-3, "x" * 3000), (-4, "日本。" * 400)]
    df = spark.createDataFrame([tuple(r) for r in texts], "doc_id long, text string").repartition(2)
    got = packing.pack(df, vocabulary("byte_bpe_50k.json"), 0, size).toPandas().sort_values(["doc_id", "start"])
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in (tuple(r) for r in texts)}
    for doc, part in got.groupby("doc_id"):
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and int(part["length"].sum()) == len(ids[doc])
        assert (part["doc_tokens"] == len(ids[doc])).all() and (part["length"] <= size).all()
        assert part["ids_crc32"].tolist() == [zlib.crc32(ids[doc][a : a + n].tobytes()) for a, n in zip(part["start"], part["length"], strict=True)]
    assert set(got["doc_id"]) == set(ids)
    assert got.groupby("sequence_id")["length"].sum().max() <= size


def longest(pattern, texts):
    """The longest prefix of ``pattern`` that occurs in the texts, none of its bytes outside."""
    n = 0
    while n < len(pattern) and pattern[n] != rindex_dedup.OUTSIDE and any(pattern[: n + 1] in t for t in texts):
        n += 1
    return n


def passage_rows():
    rng = np.random.default_rng(4)
    around = rng.integers(97, 100, (30, rindex_dedup.WIDE)).astype(np.uint8)
    for k in range(10, 30):  # pieces of the first ten
        a, b = rng.integers(0, 20, 2)
        around[k, a : a + 60] = around[k % 10, b : b + 60] if k % 3 else around[k % 10, a : a + 60]
    around[4, 70:] = around[6, :20] = rindex_dedup.OUTSIDE
    return around


def test_matching_statistics_of_other_texts():
    """Texts that are not in the index: each match is as long as can be, and ids are those of the matched class."""
    around = passage_rows()
    index = rindex_dedup.RunIndex(around[:15], np.arange(15))
    least, lengths = index.stream(around[15:])
    held = [bytes(x) for x in around[:15]]
    for r in range(15):
        for k in range(rindex_dedup.REACH + 1):
            p = bytes(around[15 + r, k:])
            assert lengths[r, k] == longest(p, held)
            want = [i for i, t in enumerate(held) if p[:50] in t]
            assert least[r, k] == (min(want) if lengths[r, k] >= 50 else rindex_dedup.NEVER)
    assert (lengths >= 50).any() and (lengths < 50).any()
    assert len(index.runs) < 0.6 * index.size


@pytest.mark.parametrize("which", ["sample", "sample_first"])
def test_run_samples_decide(which):
    around = passage_rows()
    good = rindex_dedup.RunIndex(around, np.arange(30))
    least, lengths = good.stream(around)
    assert (lengths >= 50).any()
    setattr(good, which, np.roll(getattr(good, which), 1))
    broken, other = good.stream(around)
    assert not np.array_equal(other, lengths) and not np.array_equal(broken, least)


def local_removal(texts, monkeypatch):
    """The operator's steps over several blocks, in this process: (removed bytes by document, rows asked for)."""
    monkeypatch.setattr(rindex_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(rindex_dedup, "BLOCK_BYTES", 1500)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), pa.array([t for _, t in texts], pa.string())], names=["doc_id", "text"])
    blocks = [rindex_dedup.Block(row) for b in rindex_dedup.block_rows(iter([batch])) for row in b.to_pylist()]

    def ask(question, answer):
        replies = [r for out in answer(iter([q for b in blocks for q in question(b)])) for r in out.to_pylist()]
        return [[r for r in replies if r["block"] == b.block] for b in blocks]

    for b, replies in zip(blocks, ask(lambda b: b.ask_keys(1), rindex_dedup.answer_keys), strict=True):
        b.keep_repeated(replies, 1)
        b.surroundings()
    found = ask(lambda b: b.ask_surroundings(1), rindex_dedup.answer_surroundings)
    out = [r for b, replies in zip(blocks, found, strict=True) for r in rindex_dedup.finish(b, b.marks(replies, 1), True).to_pylist()]
    assert len(blocks) > 2
    return out, sum(len(b.around) for b in blocks)


def test_hot_anchors_are_split(monkeypatch):
    """With every anchor split into its windows the same bytes go; with a hot one split no window holds many rows of it."""
    rng = np.random.default_rng(6)
    some = lambda n, kinds=26: "".join(map(chr, rng.integers(97, 97 + kinds, n)))
    line = some(90)
    texts = [(i, some(30, 3) + line[: 60 + i % 30] + some(30, 3) + ("é" * 40 if i % 5 == 0 else "")) for i in range(60)]
    texts += [(100, line), (101, line[:50]), (102, line[:49]), (None, line), (103, ""), (104, None)]
    plain, _ = local_removal(texts, monkeypatch)
    monkeypatch.setattr(rindex_dedup, "HOT", 0)
    split, n = local_removal(texts, monkeypatch)
    assert split == plain and sum(r["n_removed"] > 0 for r in plain) > 50 and n > 0


def test_copies_of_whole_texts_ask_nothing(monkeypatch):
    """Copies with larger ids go whole, as they do by their passages, and add no surroundings to those of the distinct texts."""
    monkeypatch.setattr(rindex_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(rindex_dedup, "BLOCK_BYTES", 1500)
    rng = np.random.default_rng(8)
    some = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    line = some(80)
    texts = [(i, some(60) + line[: 50 + i] + some(60)) for i in range(12)] + [(20, line[:50]), (21, line[:49]), (22, ""), (23, None)]
    copied = texts + [(100 * k + i, t) for k in range(1, 6) for i, t in texts] + [(None, texts[0][1]), (None, texts[1][1]), (3, texts[3][1]), (None, some(70)), (5, line[:49])]
    copied[:16], copied[40:56] = copied[40:56], copied[:16]

    def removal(rows, told):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["doc_id", "text"])
        held = [row for b in rindex_dedup.block_rows(iter([batch])) for row in b.to_pylist()]
        answers = [r for out in rindex_dedup.answer_copies(iter(q for row in held for q in rindex_dedup.Digests(row).ask(1))) for r in out.to_pylist()]
        copies = [rindex_dedup.Digests(row).copies([r for r in answers if r["block"] == row["block"]], 1) if told else None for row in held]
        blocks = [rindex_dedup.Block(row, c) for row, c in zip(held, copies, strict=True)]

        def ask(question, answer):
            replies = [r for out in answer(iter([q for b in blocks for q in question(b)])) for r in out.to_pylist()]
            return [[r for r in replies if r["block"] == b.block] for b in blocks]

        for b, replies in zip(blocks, ask(lambda b: b.ask_keys(1), rindex_dedup.answer_keys), strict=True):
            b.keep_repeated(replies, 1)
            b.surroundings()
        found = ask(lambda b: b.ask_surroundings(1), rindex_dedup.answer_surroundings)
        out = [r for b, replies in zip(blocks, found, strict=True) for r in rindex_dedup.finish(b, b.marks(replies, 1), True).to_pylist()]
        return out, sum(len(b.around) for b in blocks), len(blocks)

    told, few, n = removal(copied, True)
    plain, many, _ = removal(copied, False)
    assert told == plain and n > 5
    assert 0 < few < many / 4


def test_only_rows_that_may_share_a_string_are_indexed():
    """Rows that share SPAN bytes in place are all met, rows that share fewer than a window's are not, and ends of texts never count."""
    rng = np.random.default_rng(9)
    around = rng.integers(97, 123, (60, rindex_dedup.WIDE)).astype(np.uint8)
    around[:, rindex_dedup.REACH : rindex_dedup.REACH + rindex_dedup.GRAM] = 97
    keys = np.repeat(np.arange(20), 3)
    for k in range(17):
        around[3 * k + 1, 2 * k : 2 * k + 50] = around[3 * k, 2 * k : 2 * k + 50]
    around[52, 20:62] = around[51, 20:62]
    around[54:56, :49], around[54:56, 49:] = around[54, :49], rindex_dedup.OUTSIDE
    met = rindex_dedup.meeting(around, keys)
    assert met.tolist() == [k < 17 and i < 2 for k in range(20) for i in range(3)]
    least = np.arange(60)
    found = np.where(rindex_dedup.whole_strings(around), least[:, None], rindex_dedup.NEVER)
    found[met] = rindex_dedup.smallest(around[met], keys[met], least[met])
    assert np.array_equal(found, rindex_dedup.smallest(around, keys, least))
    assert len(rindex_dedup.meeting(around[:0], keys[:0])) == 0


def kinds_of(data):
    """The transforms of a file, and whether its main image has copies."""
    bits = webp.Bits(data[20:])
    bits.at, found = 40, []
    while bits.read(1):
        kind = bits.read(2)
        found.append(kind)
        if kind == webp.PREDICTOR:
            bits.read(3)
            webp.read_pixels(bits, 1, 1, False)
        else:
            webp.read_pixels(bits, bits.read(8) + 1, 1, False)
    bits.read(2)
    return found, webp.read_code(bits, 256 + webp.N_LENGTHS).top >= 256


def test_the_encoder_takes_what_shrinks_a_file(monkeypatch):
    rng = random.Random(4)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(300)).encode()
    line = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(9)).encode() + b"\n"
    cases = {
        "plain": (prose, ([], False)),
        "palette": (bytes(rng.choices(b"01", k=5000)), ([webp.PALETTE], False)),
        "ramp": (bytes((i + i // 64) % 251 for i in range(6400)), ([webp.PREDICTOR], False)),
        "copies": (line * 80 + prose[:100] + line * 3, ([], True)),
    }
    for name, (raw, want) in cases.items():
        payload = webp.padded(raw)
        stored = webp.encode_samples(payload)
        assert kinds_of(stored) == want, name
        assert webp.decode_samples(stored) == payload
        assert len(stored) <= len(webp.riff(64, len(payload) // 64, webp.plain_body(np.frombuffer(payload, np.uint8))))
    assert len(webp.encode_samples(webp.padded(line * 80))) < 400
    for _ in range(150):
        raw = b"".join(rng.choice([b"a", b"bc", line[:20], bytes(rng.choices(range(256), k=5)), b"\0" * 70, line]) * rng.randrange(30) for _ in range(rng.randrange(12)))
        payload = webp.padded(raw)
        assert webp.decode_samples(webp.encode_samples(payload)) == payload
    monkeypatch.setattr(webp, "MOST", 640)
    payload = webp.padded(prose)
    stored = webp.encode_samples(payload)
    assert stored.count(b"RIFF") == -(-len(payload) // 640) and webp.decode_samples(stored) == payload


def test_a_file_of_another_encoder():
    """A fixed file, published as a probe of lossless support: one transparent or opaque black pixel."""
    width, height, pixels = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert (width, height, len(pixels)) == (1, 1, 1) and int(pixels[0]) & 0xFFFFFF == 0


def test_predictors_by_the_format():
    """Each mode by channel, from the words of the format, against the module's packed arithmetic."""

    def channel(mode, le, t, tl, tr, s):
        avg = lambda a, b: (a + b) // 2
        clamp = lambda x: max(0, min(255, x))
        half = avg(le, t) - tl
        return [0, le, t, tr, tl, avg(avg(le, tr), t), avg(le, tl), avg(le, t), avg(tl, t), avg(t, tr), avg(avg(le, tl), avg(t, tr)), le if s else t, clamp(le + t - tl), clamp(avg(le, t) + (half // 2 if half >= 0 else -(-half // 2)))][mode]

    rng = random.Random(1)
    for _ in range(300):
        le, t, tl, tr = ([rng.randrange(256) for _ in range(4)] for _ in range(4))
        p = [t[k] + le[k] - tl[k] for k in range(4)]
        nearer_left = sum(abs(p[k] - le[k]) for k in range(4)) < sum(abs(p[k] - t[k]) for k in range(4))
        pack = lambda x: sum(v << 8 * k for k, v in enumerate(x))
        for mode in range(14):
            want = pack([channel(mode, le[k], t[k], tl[k], tr[k], nearer_left) for k in range(4)]) if mode else 0xFF000000
            assert webp.PREDICT[mode](pack(le), pack(t), pack(tl), pack(tr)) == want


def test_near_codes_go_outwards():
    """120 places before a pixel: all at once, nearer ones first, and the last eight columns of seven rows are complete."""
    assert len(set(webp.NEAR)) == 120 and all(y > 0 or x > 0 for x, y in webp.NEAR)
    squares = [x * x + y * y for x, y in webp.NEAR]
    assert squares == sorted(squares)
    assert set(webp.NEAR) == {(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0} 


def test_media_columns_of_the_contract(spark):
    texts = [(1, "abc"), (2, None), (3, ""), (4, "é" * 500), (5, "abc"), (None, "line\n" * 900), (7, "01" * 700)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    stored = webp.write_media(df)
    files = {(r["doc_id"], r["n_bytes"]): bytes(r["media"]) for r in stored.collect()}
    for r in webp.media_report(stored).collect():
        text = dict(texts)[r["doc_id"]]
        payload = webp.padded((text or "").encode())
        held = files[r["doc_id"], r["n_bytes"]]
        assert r["n_bytes"] == len((text or "").encode()) and r["payload_bytes"] == len(payload) and len(payload) % 64 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(held) and r["media_sha256"] == hashlib.sha256(held).hexdigest()
        x = np.frombuffer(payload, np.uint8)
        shares = ",".join(str(int(((x >= 64 * k) & (x < 64 * k + 64)).sum())) for k in range(4))
        assert r["feature"] == f"{len(payload) // 64}:{x.mean():.4f}:{x.std():.4f}:{shares}"


def test_links_of_a_table_equal_all_pairs(spark):
    """All fingerprints of a driver table and planted neighbours of some, against every pair; few meet by chance."""
    prints = [r[0] for r in simhash.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).select("print").distinct().collect()]
    rng = np.random.default_rng(2)
    near = [p ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False)) for p in prints[:150]]
    held = np.unique(np.array(prints + near, np.int64))
    df = spark.createDataFrame([(int(x),) for x in held], "print long")
    links = {frozenset((r["u"], r["v"])) for r in simhash.links(df).collect()}
    close = np.bitwise_count(held.view(np.uint64)[:, None] ^ held.view(np.uint64)[None, :]) <= 4
    pairs = {frozenset((int(held[i]), int(held[j]))) for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True)}
    assert links == pairs and len(pairs) >= 140
    row, key = simhash.keys(held)
    assert np.unique(np.stack([key, row], 1), axis=0).shape[0] == len(key) and len(key) - len(np.unique(key)) < len(key) / 20


def test_held_out_quality(spark):
    """Of the labelled documents that were not learned from, the score ranks by label; figures in the README."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = fm_quality.quality_scores(docs, labels).where("held_out").join(labels.where("quality IS NOT NULL"), "doc_id").toPandas()
    good, bad = got.loc[got["quality"] == 1, "score"].to_numpy(), got.loc[got["quality"] == 0, "score"].to_numpy()
    auc = ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()).item()
    accuracy = (got["predicted"] == got["quality"]).mean()
    print(f"held-out AUC {auc:.4f}, accuracy {accuracy:.4f}, rows {len(got)}")
    assert len(got) > 50 and auc > 0.97 and accuracy > 0.95


def test_quality_reads_one_text_of_a_repeated_id(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good words here {i} " * 5, None) for i in range(40)] * 3 + [(100 + i, "!!! $$$ " * 9, None) for i in range(40)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(fm_quality, "fit", lambda found, y, **k: seen.append((len(found), sum(len(i) for i, _ in found))) or fm_quality.Machine(0.0, np.zeros(fm_quality.SIZE), np.zeros((fm_quality.SIZE, 1))))
    fm_quality.train(docs, labels)
    monkeypatch.setattr(fm_quality, "MOST_FEATURES", seen[0][1] // 2)
    fm_quality.train(docs, labels)
    assert seen[0][0] == 80 and 30 <= seen[1][0] <= 45 and seen[1][1] <= seen[0][1] // 2


def run_stages(spark, docs, folder):
    import corpus_pipeline

    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), name)
        kept[name] = docs
    return kept


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns with clashing names, an empty table."""
    folder = f"file://{tmp_path}"
    ddl = "doc_id long, text string, lang string, source string, n_chars long, _id string, _nth string, _score string, _kinds string, secret_spans string, _block string, _number string, _seen string, _digest string, block string, number string"
    long = " ".join(f"w{i}" for i in range(9000))
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two  three four five six"), (3, None), (4, ""), (None, "seven eight nine ten eleven"), (None, None), (5, 'x api_key = "abcdefgh" y'), (6, long), (7, long + " end"), (8, "é" * 300), (9, "other words that stand alone in here")]
    rows = [(i, t, "en" if i else None, None, len(t) if t else None, *"abcdefghijk") for i, t in texts]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, ddl).repartition(2)
    kept = run_stages(spark, docs, folder)
    for name in ("quality", "exact", "near", "secrets"):
        assert kept[name].columns == docs.columns
    assert kept["quality"].count() == len(texts)  # without labels every score is one half
    exact = [(r["doc_id"], r["text"]) for r in kept["exact"].collect()]
    # Equal but for blanks: the longer text stays; null and empty texts are one.
    assert sorted(i for i, _ in exact if i is not None) == [2, 3, 5, 6, 7, 8, 9] and sum(i is None for i, _ in exact) == 1
    near = {r["doc_id"] for r in kept["near"].collect()}
    assert near == {2, 3, 5, 6, 8, 9, None}
    masked = {r["doc_id"]: r for r in kept["secrets"].collect()}
    assert "abcdefgh" not in masked[5]["text"] and masked[5]["n_chars"] == len(masked[5]["text"]) and masked[9]["text"] == dict(texts)[9] and masked[5]["secret_spans"] == "e"
    assert {r["doc_id"] for r in kept["packing"].collect()} == near
    empty = run_stages(spark, spark.createDataFrame([], ddl), folder)
    assert all(df.count() == 0 for df in empty.values())


def test_postings_answer_rules_that_came_later(spark):
    """A rule unknown when the index was built, one in capitals, one without trigrams; letters fold in ASCII alone."""
    long = "z" * (secrets.PIECE - 2) + "needle9 " + "z" * secrets.PIECE
    texts = [(1, "a needle7 here"), (2, "NEEDLE8"), (3, "need le"), (4, long), (5, None), (6, ""), (7, "ſecret: abcdefgh toKen: abcdefgh token: abcdefgh"), (None, "needle1"), (8, "x" * 3 + "needle3 needle4 " * 700)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    index = secrets.TrigramIndex(df)
    rules = (secrets.Rule("late", "(?:needle|NEEDLE)[0-9]"), secrets.Rule("digit", "[0-9]+"))
    with index.in_place():
        scanned = index.scan(rules, "spans")
        plan = scanned._jdf.queryExecution().executedPlan().toString()
        got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in scanned.collect()}
    assert "Exchange" not in plan
    for i, t in texts:
        want = sorted((m.start(), k, r.kind, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, t or ""))
        assert got[i] == [(kind, a, b) for a, _, kind, b in want]
    narrow = secrets.TrigramIndex(df, rules)
    with narrow.in_place():
        assert {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in narrow.scan(rules, "spans").collect()} == got
    assert narrow.postings.select("trigram").distinct().count() == len(secrets.asked_trigrams(rules)) < index.postings.select("trigram").distinct().count()
    found = index.candidates(rules).agg({"*": "count"}).first()[0]
    assert found == 5
    report = {r["doc_id"]: r for r in secrets.secret_report(df).collect()}
    assert report[7]["n_assign"] == 1
    masked = secrets.mask_secrets(spark.createDataFrame([(1, "é token: abcdefgh, " * 900)], "doc_id long, text string")).first()["text"]
    assert masked == "é <assign>, " * 900


def test_strings_are_asked_for_by_their_least_anchors(monkeypatch):
    """Each string is an anchor's own just where that anchor's gram is its least one, and surroundings end with the own strings."""
    monkeypatch.setattr(rindex_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(12)
    texts = ["".join(map(chr, rng.integers(97, 97 + kinds, n))) for kinds, n in ((26, 400), (2, 300), (1, 130), (26, 50), (26, 49), (1, 0))] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    row = next(rindex_dedup.block_rows(iter([batch]))).to_pylist()[0]
    b = rindex_dedup.Block(row)
    h = rindex_dedup.gram_hashes(b.text)
    starts = [s for e, n in zip(b.ends.tolist(), b.length.tolist(), strict=True) for s in range(e - n, e - 49)]
    want = {(s, p) for s in starts for p in range(s, s + 35) if h[p] == h[s : s + 35].min()}
    own = zip(b.at.tolist(), b.doc.tolist(), b.first.tolist(), b.last.tolist(), strict=True)
    got = {(p - 34 + j, p) for p, d, first, last in own for j in range(first, last + 1) if b.ends[d] - b.length[d] <= p - 34 + j <= b.ends[d] - 50}
    assert got == want and {s for s, _ in want} == set(starts)
    for hot in (False, True):
        b = rindex_dedup.Block(row)
        n = len(b.keys)
        b.hot = np.full(n, hot)
        parts = [b.wave(w) for w in range(rindex_dedup.WAVES)]
        assert sum(len(p.keys) for p in parts) == n and len({k for p in parts for k in set(p.keys.tolist())}) == len(set(b.keys.tolist()))
        b.surroundings()
        whole = rindex_dedup.whole_strings(b.around)
        assert hot or whole.sum(1).max() <= 35 and (b.around == rindex_dedup.OUTSIDE).mean() > 0.1
        replies = []
        for x in (b, *parts):
            if x is not b:
                x.surroundings()
            found = rindex_dedup.answer_surroundings(iter(list(x.ask_surroundings(1))))
            replies.append(x.marks([r for out in found for r in out.to_pylist()], 1))
        assert replies[0].any() and np.array_equal(replies[0], np.any(replies[1:], 0))
        assert replies[0].tolist() == [False] * (len(b.text) // 2) + np.repeat(b.length >= 50, b.length)[len(b.text) // 2 :].tolist()


def test_passages_leave_no_shuffle_on_disk(spark):
    """What was shuffled for a round of answers is deleted when they are written, and each wave's before the next one."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    left = rindex_dedup.remove_repeats(common.documents(spark, "/root/testdata/sf0.001"))
    assert not files() - before
    assert left.agg({"n_removed": "sum"}).first()[0] > 0
