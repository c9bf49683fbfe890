import collections
import hashlib
import re
import string
import zlib

import numpy as np
import pytest

from plumbline.llm import chunks, jaccard, mixing, pieces, recompression, secrets, suffixes

WORD = re.compile("[^ \t-\r]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# --- secrets --------------------------------------------------------------------------------------------------------

PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(text) if ok(m))


def test_secret_spans(docs):
    rows = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    for i, text in texts_of(docs):
        got = sorted((s["start"], secrets.BASE.index(s["kind"]), s["end"]) for s in rows[i] if s["kind"] in secrets.BASE)
        assert got == brute_spans(text), i
    assert any(s["kind"] == "github" for spans in rows.values() for s in spans)


def test_random_secrets():
    rng, scanner = np.random.default_rng(1), secrets.compiled(secrets.RULES)
    parts = ["token", "secret", "api_key", "PassWord", ":", "=", '"', "'", " ", "AKIA", "ABCD", "0123456789abcdef", "f", "9", "z", "é", "\n", "AKIAAKIA0123456", "-"]
    for _ in range(5000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        got = [x for x in secrets.code_points(text.encode(), text.isascii(), scanner.find(text.encode())) if x[1] < 3]
        assert got == brute_spans(text), text


def test_redaction(docs, empty):
    out = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert "hunter2" not in out[22] and "[secret]" in out[22] and out[0] is None and out[19] == dict(texts_of(docs))[19]
    assert secrets.redacted(empty).columns == docs.columns and secrets.scan(empty).count() == 0
    assert secrets.redact("abcdef", [(1, 0, 3), (2, 1, 4)]) == "a[secret]ef"


# --- SentencePiece --------------------------------------------------------------------------------------------------


def small_model():
    words = {"▁": -3.0, "a": -2.0, "b": -2.2, "ab": -2.5, "▁a": -2.4, "ba": -3.0, "abab": -4.5, "▁▁": -3.5}
    names = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), *words]
    return pieces.Model(names, [0.0] * 259 + list(words.values()), [2, 3, 3] + [6] * 256 + [1] * len(words))


def best_score(model, text):
    """The best segmentation, by plain recursion over all of them."""
    best = [0.0] + [-1e9] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            score = model.scores[model.words[text[i:j].encode()]] if text[i:j].encode() in model.words else model.unknown_score if j == i + 1 else -1e9
            best[j] = max(best[j], best[i] + score)
    return best[-1]


def test_viterbi_is_optimal():
    model, rng = small_model(), np.random.default_rng(2)
    for _ in range(500):
        text = "".join(rng.choice(list("aab  é\n"), rng.integers(0, 12)))
        ids = model.encode(text)
        normal = model.normal(text)
        score, at = 0.0, 0
        while at < len(ids):
            if model.kinds[ids[at]] == pieces.BYTE:
                n = {True: 1}.get(model.raw[ids[at]][0] < 128, 2)
                score, at = score + model.unknown_score, at + n
            else:
                score, at = score + model.scores[ids[at]], at + 1
        assert score == pytest.approx(best_score(model, normal)), text
        assert model.decode(ids) == text


def test_round_trip(docs, empty):
    out = {r.doc_id: r for r in pieces.encode(docs, pieces.load()).collect()}
    for i, text in texts_of(docs):
        assert out[i].decoded == text.replace("▁", " ")
        assert (len(out[i].ids) == 0) == (text == "")
    assert pieces.encode(empty, pieces.load()).count() == 0


# --- media ----------------------------------------------------------------------------------------------------------


def test_chunked_media(docs, empty):
    rows = collections.Counter()
    want = collections.Counter()
    for r in chunks.load(*chunks.store(docs), chunks.OUTPUTS, chunks.features).collect():
        rows[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes] += 1
    for i, text in texts_of(docs):
        raw = text.encode()
        data = raw + b" " * (-len(raw) % 192) or b" " * 192
        want[i, len(raw), len(data), sha(data), zlib.crc32(data[-16:]), len(data) + 44] += 1
    assert rows == want
    assert chunks.load(*chunks.store(empty), chunks.OUTPUTS, chunks.features).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 256, 60_000, dtype=np.uint8)
    a, b = np.concatenate([rng.integers(0, 256, 777, dtype=np.uint8), shared]), np.concatenate([rng.integers(0, 256, 5000, dtype=np.uint8), shared])
    parts = [{d[x:y].tobytes() for x, y in zip([0, *chunks.cuts(d)], chunks.cuts(d), strict=False)} for d in (a, b)]
    assert len(parts[0] & parts[1]) > 0.8 * len(parts[0])
    ends = chunks.cuts(np.zeros(30_000, np.uint8))
    assert ends[-1] == 30_000 and max(np.diff([0, *ends])) <= 8192


# --- Jaccard --------------------------------------------------------------------------------------------------------


def brute_components(rows, words, percent):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = collections.defaultdict(set)
    for i, t in rows:
        w = WORD.findall(t.translate(lower))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_components(docs, words, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, words=words, percent=percent).collect()}
    assert got == brute_components(texts_of(docs), words, percent)


def test_components_of_many_near_copies(spark, empty):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in rng.integers(0, 500, 120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 120, i % 4):
            words[at] = f"new{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute_components(rows, 3, 90)
    assert jaccard.near_duplicates(empty).count() == 0


def test_signatures_never_miss():
    rng = np.random.default_rng(5)
    for size in (5, 9, 10, 13, 30, 100, 400):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            most = int((1 - 0.9) / (1 + 0.9) * 2 * len(a))
            drop, add = rng.integers(0, most // 2 + 1), rng.integers(0, most // 2 + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            if jaccard.linked(a, b, 90):
                assert set(jaccard.signatures(a, 90)[0]) & set(jaccard.signatures(b, 90)[0])


# --- repeats --------------------------------------------------------------------------------------------------------


def brute_words(rows, window):
    seen, out = set(), {}
    for i, text in sorted(dict(rows).items()):
        w = WORD.findall(text)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return out


def brute_bytes(rows, length):
    counts = collections.Counter(t.encode()[j : j + length] for _, t in rows for j in range(len(t.encode()) - length + 1))
    out = {}
    for i, text in rows:
        b = text.encode()
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - length + 1):
            if counts[b[j : j + length]] > 1:
                gone[j] += 1
                gone[j + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def word_rows(df, **kw):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.remove_repeats(df, **kw).collect()}


def byte_rows(df, **kw):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df, **kw).collect()}


def test_repeats(docs, empty):
    assert word_rows(docs) == brute_words(texts_of(docs), 20)
    assert byte_rows(docs) == brute_bytes(texts_of(docs), 200)
    assert recompression.remove_repeats(empty).count() == 0 and suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_repeats(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("ab "), 40)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [str(rng.choice(pool)) if rng.random() < 0.6 else " ".join(map(str, rng.integers(0, 30, 8))) for _ in range(rng.integers(0, 6))]
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert word_rows(df, window=6) == brute_words(rows, 6)
    assert byte_rows(df, length=24, gram=9) == brute_bytes(rows, 24)


def test_anchors_of_a_short_document_alone():
    """A document's anchors don't depend on what else lies in its slice."""
    rng = np.random.default_rng(9)
    long = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for n in rng.integers(20, 30, 200).tolist():
        short = rng.integers(0, 1 << 63, n).astype(np.uint64)
        alone = recompression.anchors(short, np.array([0, n]), 20)
        beside = recompression.anchors(np.concatenate([short, long]), np.array([0, n, n + len(long)]), 20)
        here = beside[1] < n
        assert [x.tolist() for x in alone] == [x[here].tolist() for x in beside]


@pytest.mark.parametrize("window", [6, 20])
def test_passages_that_begin_and_end_with_doubled_words(window):
    """A passage of just a window has a common anchor in all contexts."""
    rng = np.random.default_rng(10)
    names = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    for _ in range(1500):
        passage = names[rng.integers(0, 12, window)]
        kind = rng.integers(0, 3)
        if kind == 0:
            passage[1], passage[-2] = passage[0], passage[-1]
        elif kind == 1:
            passage[2:4], passage[-4:-2] = passage[:2], passage[-2:]
        else:
            passage[:] = np.resize(passage[: rng.integers(1, 4)], window)
        found = []
        for _ in range(2):
            left, right = (names[rng.integers(0, 12, rng.integers(0, 9))] for _ in range(2))
            if rng.random() < 0.5:
                left, right = np.append(left, passage[0]), np.insert(right, 0, passage[-1])
            fp, a, b = recompression.anchors(np.concatenate([left, passage, right]), np.array([0, len(left) + window + len(right)]), window)
            inside = (a >= len(left)) & (b <= len(left) + window)
            found.append(set(zip(fp[inside].tolist(), (a[inside] - len(left)).tolist(), strict=True)))
        assert found[0] & found[1]


def test_groups_judged_in_parts(spark):
    """Groups larger than group_rows go through the salted level."""
    rows = [(i, f"x{i} " + " ".join(f"s{j}" for j in range(60)) + f" y{i % 3}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for module, make, brute in (
        (recompression, (recompression.word_anchors(20), recompression.window_hashes(20), "windows binary", recompression.later_windows(20), recompression.kept_words(20)), brute_words(rows, 20)),
        (suffixes, (suffixes.byte_anchors(200, 73), suffixes.surroundings(200, 73), "around binary, n_before long", suffixes.equal_strings(200, 73), suffixes.kept_bytes(200)), brute_bytes(rows, 200)),
    ):
        anchors, cut, extra, judge, finish = make
        corpus = module.Corpus(df, "doc_id", "text")
        spans = corpus.spans(corpus.around(corpus.meeting(anchors, group_rows=7), cut, extra), judge, extra)
        names = "n long, removed long, kept string" if module is recompression else "n long, removed long, spans long, kept string"
        assert {r[0]: tuple(r[1:]) for r in corpus.finish(spans, finish, names).collect()} == brute


@pytest.mark.parametrize("window", [6, 20])
def test_equal_windows_have_equal_representatives(window):
    """Each window is among those of one symbol at least, and the symbol that stands for a passage does so in all contexts."""
    rng = np.random.default_rng(11)
    names = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    for _ in range(500):
        passage = names[rng.integers(0, rng.integers(1, 7), window)]
        found = []
        for _ in range(2):
            left, right = (names[rng.integers(0, 6, rng.integers(0, 30))] for _ in range(2))
            words = np.concatenate([left, passage, right])
            fp, a, b, offsets = recompression.representatives(words, np.array([0, len(words)]), window)
            lo, hi = np.divmod(offsets, window)
            assert (lo >= 0).all() and (lo <= hi).all() and (hi <= window - (b - a)).all()
            assert {s for x, i, j in zip(a, lo, hi, strict=True) for s in range(x - j, x - i + 1)} == set(range(len(words) - window + 1))
            at = (a - hi <= len(left)) & (len(left) <= a - lo)
            found.append(set(zip(fp[at].tolist(), (a[at] - len(left)).tolist(), strict=True)))
        assert found[0] & found[1]


@pytest.mark.parametrize("docs", [120, 240])
def test_parts_send_each_window_once(spark, docs):
    """A passage in ever more surroundings, in four tasks: only what is first in its task meets, however large the parts."""
    passage = " ".join(f"s{j}" for j in range(40))
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(25)), passage, *(f"b{i}x{j}" for j in range(25))])) for i in range(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    corpus = recompression.Corpus(df, "doc_id", "text")
    segments = corpus.around(corpus.meeting(recompression.word_anchors(20), group_rows=docs // 6), recompression.window_hashes(20), "windows binary")
    met = []

    def meet(rows):
        met.append(recompression.meeting_windows(20)(rows).count())
        return recompression.meeting_windows(20)(rows)

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        spans = corpus.spans(segments, recompression.later_windows(20), "windows binary", meet=meet)
    finally:
        spark.conf.set(key, before)
    assert {r[0]: tuple(r[1:]) for r in corpus.finish(spans, recompression.kept_words(20), "n long, removed long, kept string").collect()} == brute_words(rows, 20)
    # 21 windows, each first in at most four tasks; two symbols may hold one.
    assert 0 < met[0] <= 2 * 21 * 3


def test_frequent_line_with_different_surroundings(spark):
    """No group of suffixes is larger than allowed, though all rows of the line's anchors survive the first level."""
    line = "".join(f"licence line {i} " for i in range(12))[:190]
    rows = [(i, sha(bytes([i])) * 3 + line[: 190 - 40 * (i % 2)] + sha(bytes([i // 3, 1])) * 3) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    judge = suffixes.equal_strings(200, 73)

    def bounded(table):
        by = [c for c in ("fp", "salt", "lo", "hi", "key") if c in table.column_names]
        assert max(collections.Counter(zip(*(table.column(c).to_pylist() for c in by), strict=True)).values()) <= 25
        return judge(table)

    corpus = suffixes.Corpus(df, "doc_id", "text")
    extra = "around binary, n_before long"
    segments = corpus.around(corpus.meeting(suffixes.byte_anchors(200, 73), group_rows=8), suffixes.surroundings(200, 73), extra)
    spans = corpus.spans(segments, bounded, extra, suffixes.halved(200, 73), group_rows=8)
    out = corpus.finish(spans, suffixes.kept_bytes(200), "n long, removed long, spans long, kept string")
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute_bytes(rows, 200)
    with pytest.raises(Exception, match="AssertionError"):
        corpus.spans(segments, bounded, extra)  # without a split, all of them meet


def test_queue_spills():
    rng = np.random.default_rng(6)
    byte, row, common = rng.integers(0, 9, 1000).astype(np.uint8), np.arange(1000), rng.integers(1, 5, 1000)
    out = []
    for room in (10, 10_000):
        queue = suffixes.ByteQueue(room)
        for i in range(0, 1000, 50):
            queue.push(byte[i : i + 50], row[i : i + 50], common[i : i + 50].copy())
        out.append(np.concatenate([r for r, _ in queue.pop()]))
    assert (out[0] == out[1]).all() and (out[0] == np.argsort(byte, kind="stable")).all()


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_mix(docs, empty):
    out = sorted(mixing.mix_sources(docs).collect(), key=str)
    again = sorted(mixing.mix_sources(docs.repartition(7)).collect(), key=str)
    assert [r.copies for r in out] == [r.copies for r in again] and len(out) == docs.count()
    assert all(0 <= r.copies <= 2 for r in out)
    for text, row in {(t, i) for i, t in texts_of(docs)}:
        assert any(r.doc_id == row and r["size"] == len(WORD.findall(text)) for r in out)
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == sum(r.copies for r in out)


def test_targets():
    got = mixing.targets({"a": 100, "b": 100, None: 1000})
    assert got == {"a": 200.0, "b": 200.0, None: 1400.0}  # weights 3, 1, 2 of 1800: all of a's and b's shares are above their caps
    assert sum(mixing.targets({"a": 10, "b": 0}).values()) == 15.0


@pytest.mark.parametrize("block", [30, 10_000])
def test_mix_meets_targets(spark, block):
    rng = np.random.default_rng(7)
    rows = [(i, f"s{i % 3}", " ".join(["w"] * int(rng.integers(1, 200)))) for i in range(900)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=block).toPandas()
    out["taken"] = out["size"] * out["copies"]
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) < 0.01 * g.target.iloc[0]
        assert abs(g.copies.sum() - len(g) * g.target.iloc[0] / g["size"].sum()) < 0.02 * len(g) + 3


def test_flight_keeps_totals():
    rng = np.random.default_rng(8)
    size = rng.integers(1, 1000, 300).astype(float)
    p = mixing.fly(np.full(300, 0.37), size, rng.random(300))
    open_ = (p > 0) & (p < 1)
    assert open_.sum() <= 2 and p.sum() == pytest.approx(0.37 * 300) and (p * size).sum() == pytest.approx(0.37 * size.sum())


# --- ids ------------------------------------------------------------------------------------------------------------


def line(start, n, changed=()):
    return " ".join(f"c{i}" if i in changed else f"u{i}" for i in range(start, start + n))


@pytest.fixture(scope="module")
def odd_ids(spark):
    """Ids that repeat with other texts, and null ids."""
    rows = [
        (5, line(0, 200)), (5, line(5000, 60)), (3, line(5000, 60, {5030})), (9, line(0, 200, {3})),  # 5 joins 3 and 9
        (7, line(9000, 80)), (7, line(9000, 80, {9070}) + " tail"), (7, None),
        (None, line(0, 200, {190})), (None, line(12000, 90)), (None, line(12000, 90, {12004})), (None, line(12000, 90)), (None, None),
        (11, ""), (12, line(20000, 50)), (None, line(20000, 50)),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_components_of_repeated_and_null_ids(odd_ids):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd_ids).collect())
    assert got == collections.Counter([
        (5, 198, 3), (5, 58, 3), (3, 58, 3), (9, 198, 3), (7, 78, 7), (7, 79, 7), (7, 0, 7), (None, 198, 3), (None, 88, None), (None, 88, None), (None, 88, None), (None, 0, None),
        (11, 0, 11), (12, 48, 12), (None, 48, 12),
    ])


def test_stage_keeps_null_ids(spark, odd_ids):
    import corpus_pipeline

    kept = corpus_pipeline.near_duplicate_stage(spark, odd_ids, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [3, 7, 7, 7, 11, 12]
    assert sorted((r.text or "")[:6] for r in kept if r.doc_id is None) == ["", "u12000"]


def test_repeats_of_repeated_and_null_ids(odd_ids):
    rows = [(k, r.text or "") for k, r in enumerate(sorted(odd_ids.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)))]
    got = collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(odd_ids).collect())
    assert got == collections.Counter(brute_bytes(rows, 200).values())
    out = recompression.remove_repeats(odd_ids).collect()
    assert len(out) == 15 and sum(r.n_removed for r in out if r.doc_id == 7) == 70  # one of both texts of 7 stays whole
    assert [r.n_removed for r in out if r.doc_id in (3, 5) and r.n_words == 60].count(0) == 1
    assert [(r.n_words, r.n_removed) for r in out if r.doc_id == 12] == [(50, 0)]
    assert sum(r.n_removed for r in out if r.doc_id is None and r.n_words == 50) == 50
