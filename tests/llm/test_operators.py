"""The operators against brute force on odd documents, and on empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from equiloom.llm import common as C
from equiloom.llm import chat_format, decontaminate, license_scan, mixing_coder, piece_encoder, quality_rules, simhash_dedup, source_mix, substring_dedup, suffix_dedup, suffix_sort, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def bag(pairs):
    return Counter(pairs)


def covered(items, size):
    """Which items of each sequence lie in a window that also starts elsewhere."""
    count = Counter(tuple(x[i : i + size]) for x in items for i in range(len(x) - size + 1))
    out = []
    for x in items:
        gone = [False] * len(x)
        for i in range(len(x) - size + 1):
            if count[tuple(x[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


@pytest.mark.parametrize("size", [35, 7, 2])
def test_substrings(odd, size):
    rows = rows_of(odd)
    items = [WORD.findall(t) for _, t in rows]
    want = []
    for (d, _), w, gone in zip(rows, items, covered(items, size), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.dedup_substrings(odd, size).collect()
    assert bag((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == bag(want)


@pytest.mark.parametrize(("size", "shard"), [(200, 1 << 20), (60, 500)])
def test_suffixes(odd, size, shard):
    odd = odd.withColumn("text", F.left("text", F.lit(6000)))
    rows = [(d, t.encode()) for d, t in rows_of(odd)]
    count = Counter(t[i : i + size] for _, t in rows for i in range(len(t) - size + 1))
    want = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        want.append((d, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.dedup_suffixes(odd, size, shard).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == bag(want)


def test_suffix_stretches(monkeypatch):
    """Regions do not depend on where a long text is cut to be read."""
    rng = np.random.default_rng(6)
    buf = rng.integers(97, 100, 3000).astype(np.uint8)
    offs = np.array([0, 0, 700, 700, 2990, 3000])
    one = suffix_dedup._regions(buf, offs, 60)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 128)
    many = suffix_dedup._regions(buf, offs, 60)
    windows = [{(int(r), int(a) + i, int(h)) for r, a, n, h in zip(*x, strict=True) for i in range(n)} for x in (one, many)]
    assert windows[0] == windows[1] and sum(one[2]) == 700 - 59 + 2290 - 59


@pytest.mark.parametrize("base", [1 << 17, 2])
def test_suffix_array(monkeypatch, base):
    monkeypatch.setattr(suffix_sort, "BASE", base)
    rng = np.random.default_rng(3)
    for i in range(300):
        t = rng.integers(0, 1 + i % 4, i % 37)
        t = np.tile(t, 3) if i % 3 == 0 else t
        sa = suffix_sort.suffix_array(t, 5)
        assert list(sa) == sorted(range(len(t)), key=lambda j: list(t[j:]))
        if len(t) > 1:
            shared = suffix_sort.common_prefixes(t, sa)
            for a, b in zip(sa[:-1], sa[1:], strict=True):
                n = 0
                while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                    n += 1
                assert shared[b] == n


def simhash(text, width=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    s = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints, bits):
    """Least id of each one's component, and its root."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups: dict = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(d)
    return [(min((d for d in groups[find(i)] if d is not None), default=None), find(i)) for i in range(len(prints))]


def test_simhash(odd):
    prints = [(d, simhash(t)) for d, t in rows_of(odd)]
    want = bag((d, f"{p:016x}", c) for (d, p), (c, _) in zip(prints, grouped(prints, 3), strict=True))
    assert bag((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_components(odd).collect()) == want
    kept = simhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r for _, r in grouped(prints, 3)})


@pytest.mark.parametrize("crowd", [4, 1 << 14])
def test_links(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12)
    values = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(30):
            for p in rng.integers(0, 63, rng.integers(1, 7)):
                b ^= 1 << int(p)
            values.add(b)
    from equiloom.llm.components import components

    prints = sorted(values)
    frame = spark.createDataFrame([(x,) for x in prints], "fp long")
    label = {r.u: r.m for r in components(simhash_dedup.near_links(frame, 3)).collect()}
    want = [c for c, _ in grouped([(x, x) for x in prints], 3)]
    assert [label.get(x, x) for x in prints] == want


def test_decontaminate(spark, odd):
    items = [(1, " ".join(f"p{i}" for i in range(40))), (2, "ONE two"), (3, None), (4, "nowhere to be found in any text at all"), (5, " ".join(f"p{i}" if i % 12 else "q" for i in range(60)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(odd, bench).collect()}
    assert {k for k in got if k[1] == 1} == {(2, 1), (3, 1)} and got[2, 1] == 1.0
    assert {k for k in got if k[1] == 2} == {(6, 2), (7, 2)}
    assert not {k for k in got if k[1] in (3, 4, 5)}
    clean = decontaminate.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 5


def test_quality(odd):
    got = quality_rules.quality(odd).collect()
    want = []
    for d, t in rows_of(odd):
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == bag(want)
    assert not any(r.kept and r.base_failed for r in got)


@pytest.mark.parametrize("share", [0.6, 0.85])
@pytest.mark.parametrize("errs", [0.01, 0.1, 0.3])
def test_vote_model(share, errs):
    """Planted accuracies come back, also of a rule that often errs on good."""
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < share
    bad_rate, good_rate = [0.9, 0.8, 0.7, 0.85, 0.75], [0.02, 0.05, 0.03, 0.04, errs]
    votes = np.stack([np.where(rng.random(len(good)) < 0.1, 0, np.where(rng.random(len(good)) < np.where(good, g, b), -1, 1)) for b, g in zip(bad_rate, good_rate, strict=True)], axis=1)
    patterns = sorted(Counter(map(tuple, votes.tolist())).items())
    p, rates = quality_rules.fit(patterns)
    assert abs(p - share) < 0.03
    assert np.abs(np.array(rates) - np.array([bad_rate, good_rate]).T).max() < 0.04
    said = np.array([quality_rules.posterior(tuple(v), p, rates) >= 0.5 for v in votes.tolist()])
    assert (said == good).mean() > 0.95


def test_quality_posterior(spark):
    """kept and p_good against an estimation document by document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_rules.quality(docs).collect()
    v = np.array([[r[f"vote_{k}"] for k in quality_rules.votes()] for r in rows])
    q = np.array([{0: 0.99, 1: 0.8}.get(n, 0.01) for n in (v < 0).sum(1)])
    for _ in range(200):
        p = (q.sum() + 10) / (len(q) + 20)
        ok = ((q[:, None] * (v < 0)).sum(0) + 1) / ((q[:, None] * (v != 0)).sum(0) + 20)
        bad = np.maximum(ok, (((1 - q)[:, None] * (v < 0)).sum(0) + 10) / (((1 - q)[:, None] * (v != 0)).sum(0) + 20))
        odds = np.log(p / (1 - p)) + np.where(v < 0, np.log(ok / bad), np.where(v > 0, np.log((1 - ok) / (1 - bad)), 0)).sum(1)
        q = 1 / (1 + np.exp(-odds))
    assert np.abs(np.array([r.p_good for r in rows]) - q).max() < 1e-6
    assert all(r.kept == (not r.base_failed and x >= 0.5) for r, x in zip(rows, q, strict=True))
    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    open_ = [(r.kept, marks[r.doc_id]) for r in rows if r.doc_id in marks and not r.base_failed]
    assert np.mean([k == bool(m) for k, m in open_]) > 0.98


def repaired(roles):
    """Least cost by trying all ways."""
    idx = [chat_format.role_index(r) for r in roles]
    best = {chat_format.START: 0}
    for g in idx:
        now = {}
        for s, c in best.items():
            for more, _, to, _ in chat_format._MOVES[s, g]:
                now[to] = min(now.get(to, 1e9), c + more)
        best = now
    return min(c + 2 * len(chat_format._ENDING[s]) for s, c in best.items())


def test_chat(spark, monkeypatch):
    rng = np.random.default_rng(2)
    names = ["system", "User", "assistant", "gpt", None, "tool"]
    convs = {c: [names[i] for i in rng.integers(0, 6, n)] for c, n in enumerate([1, 2, 3, 5, 9, 400])}
    rows = [(c, t, r, f"text {c} {t}") for c, rs in convs.items() for t, r in enumerate(rs)] + [(None, 0, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat_format, "ROWS", 40)  # the long one spans partitions
    got = {}
    for r in sorted(chat_format.repair(frame).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.piece)):
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == {*convs, None}
    for c, rs in convs.items():
        turns = [r.role for r in got[c] if not r.action.endswith("merge")]
        turns = turns[1:] if turns[0] == "system" else turns
        assert len(turns) % 2 == 0 and all(t == ("user", "assistant")[i % 2] for i, t in enumerate(turns))
        assert [r.text for r in got[c] if r.action != "insert"] == [f"text {c} {t}" for t in range(len(rs))]
        assert sorted({r.out_turn for r in got[c]}) == list(range(len([r for r in got[c] if not r.action.endswith("merge")])))
        body = "".join(r.rendered for r in got[c])
        assert body.count("<|end|>") == len({r.out_turn for r in got[c]}) and body.endswith("<|end|>\n")
        cost = sum({"merge": 1, "relabel": 3, "relabel+merge": 4, "insert": 2, "keep": 0}[r.action] for r in got[c])
        cost -= sum(2 for r, g in zip([r for r in got[c] if r.action != "insert"], rs, strict=True) if "relabel" in r.action and chat_format.role_index(g) is None)
        assert cost == repaired(rs)


@pytest.mark.parametrize("ids", [2, 60, 65536])
def test_coder(ids):
    rows = np.random.default_rng(ids).integers(0, ids, (40, 150)).astype(np.uint16)
    known, share = mixing_coder.prior(rows.ravel())
    assert share.sum() == mixing_coder.PARTS and share.min() >= 1
    assert (mixing_coder.decode(mixing_coder.encode(rows, known, share), 150, known, share) == rows).all()


def test_container():
    ids = np.arange(5000).astype(np.uint16) % 700
    data = token_files.pack(np.array([0, 4]), 1, np.array([1000, 4000]), ids)
    keys, nulls, counts, back = token_files.unpack(data)
    assert list(keys) == [0, 4] and nulls == 1 and list(counts) == [1000, 4000] and (back == ids).all()
    broken = bytearray(data)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack(bytes(broken))
    empty = np.empty(0, np.int64)
    assert len(token_files.unpack(token_files.pack(empty, 0, empty, empty.astype(np.uint16)))[3]) == 0


def test_compression():
    """Ids of which half follow from the one before cost less than by order 0."""
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 200, (64, 4096)).astype(np.uint16)
    ids[:, 1::2] = (ids[:, ::2].astype(int) * 7 % 200).astype(np.uint16)
    size = sum(map(len, mixing_coder.encode(ids, *mixing_coder.prior(ids.ravel()))))
    assert 8 * size / ids.size < 0.8 * np.log2(200)


def test_pieces():
    """Units cut at borders that two bytes prove give what the library gives."""
    import public_tokenizers

    encoder = piece_encoder.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    letters = [*"ab1 \n\t'st.!(é² \u3000“日\u0085\x00\x1c", "'s", "'ll", " '", "<|endoftext|>", "  ", " the"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)] + ["", "x" * 70000]
    for part in (texts, texts[::-1]):  # the second time from kept units
        ids, n = encoder(*C.utf8(pa.array(part)), 2)
        want = [[*encoder.tokenizer.encode(x, add_special_tokens=False).ids, 2] for x in part]
        assert list(n) == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_tokens(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    more = odd.limit(2).withColumn("text", F.lit("ends <|endoftext|> here")).withColumn("doc_id", F.lit(-(2**63)).cast("long"))
    odd = odd.unionByName(more)
    got = token_files.round_trip(odd, path, 2, with_ids=True).orderBy("start").collect()
    want = Counter((d, tuple([*t.encode(x, add_special_tokens=False).ids, 2])) for d, x in rows_of(odd))
    assert any(50256 in ids for _, ids in want)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)


def test_licenses(spark):
    notice = license_scan.TEMPLATES["Apache-2.0-header"]
    rows = [(1, f"filler {' '.join(f'w{i}' for i in range(50))} {notice} more"), (2, "nothing here at all to see"), (3, None), (4, "released UNDER the mit license"), (4, "released UNDER the mit license"), (5, " ".join(notice.split()[:8]))]
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "Apache-2.0-header"): 1.0, (4, "MIT"): 1.0}
    with pytest.raises(ValueError):
        license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), {"short": "too short"})


def test_mix(odd):
    got = source_mix.mix_sizes(odd).collect()
    assert len(got) == odd.count()
    sizes, target, taken = Counter(), {}, Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    total, weight, full = sum(sizes.values()), {"a": 1, "b": 2, "c": 3, None: 1}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        left = sum(weight[s] for s in sizes if s not in full)
        level = {s: 3 * sizes[s] if s in full else rest * weight[s] / left for s in sizes}
        over = {s for s in sizes if s not in full and level[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    assert all(abs(target[s] - level[s]) < 1e-6 for s in sizes)
    assert source_mix.mix_sizes(odd.repartition(7)).groupBy().sum("taken").first()[0] == sum(r.taken for r in got)
    assert source_mix.emit(odd).columns == odd.columns


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    clean = [f"c{i}" for i in range(300)]
    rows, marks = [], []
    for d in range(400):
        w = [clean[i] for i in rng.integers(0, 300, 80)]
        toxic = d % 4 == 0
        if toxic:
            w[:: 80 // (2 + d % 5)] = ["vilefool"] * len(w[:: 80 // (2 + d % 5)])
        rows.append((d, " ".join(w)))
        if d < 300:
            marks.append((d, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    held = [d for d in range(300, 400)]
    assert np.mean([got[d].toxic == (d % 4 == 0) for d in held]) > 0.97
    assert np.mean([got[d].severity for d in held if d % 4 == 0]) > 1
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.grade(docs, none).where("toxic").count() == 0


def test_toxicity_odd(odd):
    model = toxicity.Model(np.empty(0, np.uint64), np.empty(0), np.array([1.0, 2.0, 3.0]))
    assert toxicity.grade(odd, model).count() == odd.count()
    assert toxicity.drop_toxic(odd, model).columns == odd.columns


def test_empty(none, spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    import public_tokenizers

    for frame in (
        substring_dedup.dedup_substrings(none), suffix_dedup.dedup_suffixes(none), simhash_dedup.near_components(none), simhash_dedup.keep_one(none), decontaminate.matches(none, bench),
        decontaminate.drop_contaminated(none, bench.limit(0)), quality_rules.quality(none), chat_format.repair(conv), token_files.round_trip(none, public_tokenizers.path("byte_bpe_50k.json")),
        license_scan.scan_licenses(none), source_mix.mix_sizes(none), source_mix.emit(none),
    ):
        assert frame.count() == 0
