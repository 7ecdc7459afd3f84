"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyspark.sql.functions as F
import pytest
from helixframe.llm import common, decontaminate, language, mixing, packing, pii, quality, repeats, simhash, tokens, warc
from hypothesis import given, settings
from hypothesis import strategies as st

SMALL = "/root/testdata/sf0.001"


def table(spark, name, sf=SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- fingerprints and components --------------------------------------------------------


def roots_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(common.UPPER, common.LOWER)))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    docs = table(spark, "documents")
    got = {r.doc_id: r.fp[0] & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    assert got == {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}


@pytest.mark.parametrize("bucket", [4096, 8])
@pytest.mark.parametrize("tau,lanes,total", [(2, 1, None), (5, 1, None), (6, 2, 14)])
def test_links_lose_nothing(spark, bucket, tau, lanes, total):
    rng = random.Random(4)
    base = [[rng.getrandbits(64) for _ in range(lanes)] for _ in range(25)]
    rows = {tuple(w ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for w in rng.choice(base)) for _ in range(300)}
    rows = sorted(rows)
    signed = [[w - (1 << 64) if w >> 63 else w for w in r] for r in rows]
    reps = spark.createDataFrame([(i, *r) for i, r in enumerate(signed)], "rep long, " + ", ".join(f"f{k} long" for k in range(lanes)))
    got = {r.node: r.root for r in common.components(simhash.links(reps, tau, total, bucket)).collect()}

    def linked(a, b):
        d = [bin(x ^ y).count("1") for x, y in zip(a, b)]
        return min(d) <= tau and sum(d) <= (tau if total is None else total)

    want = roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if linked(rows[i], rows[j])])
    assert [got.get(i, i) for i in range(len(rows))] == want


def test_verified_links(spark):
    """Pairs by the similarity of their five-word shingles: those of 0.8 or more are found, with a recall of at least 0.9 just above it, others never."""
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(4000)]
    texts, band, want = [], {}, set()
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k in range(700):
        a = [rng.choice(vocab) for _ in range(rng.randint(60, 400))]
        b = list(a)
        for _ in range(max(1, round(len(a) * rng.uniform(0.005, 0.035)))):
            b[rng.randrange(len(b))] = rng.choice(vocab)
        x, y = shingles(a), shingles(b)
        j = len(x & y) / len(x | y)
        band[k] = j
        texts += [" ".join(a), " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, *corpus_pipeline.NEAR).collect()}
    found = {k for k in band if got[2 * k] == got[2 * k + 1]}
    assert all(got[i] // 2 == i // 2 for i in got) and all(band[k] >= 0.8 for k in found)
    for lo, hi, least in ((0.8, 0.85, 0.9), (0.85, 0.9, 0.97), (0.9, 1.0, 1.0)):
        mine = {k for k, j in band.items() if lo <= j < hi}
        assert len(mine) > 40 and len(found & mine) >= least * len(mine), (lo, len(found & mine), len(mine))


def test_links_by_way_of_rows_without_an_id(spark, monkeypatch):
    prints = {"a": 0b0, "b": 0b11, "c": 0b1111, "d": 0b111111}
    monkeypatch.setattr(simhash, "fingerprint", lambda text, words, lanes: [prints[text.decode()]])
    rows = [(5, "a"), (None, "b"), (3, "c"), (None, "b"), (None, "d")]
    for docs, want in ((rows, {3}), ([r for r in rows if r[1] != "b"], {5, 3}), ([r for r in rows if r[0] is None], {None})):
        got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r.component_id for r in got} == want and len(got) == len(docs)


def test_thresholds_sum():
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500.0)
    for tau in (0, 2, 6, 8):
        plan, cost = simhash.allocate(1000, both, tau)
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits)) and cost > 0 and plan


def test_components_of_a_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002)], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(3)}


# -- repeats ----------------------------------------------------------------------------


def brute_repeats(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_cases():
    rng = random.Random(7)
    letter = lambda n: "".join(rng.choice("abcdefgh éü") for _ in range(n))
    common_part, other = letter(260), letter(230)
    out = ["a" * 1000, "a" * 199, "ab" * 300, letter(150), "", None]
    for k in range(40):
        text = letter(rng.randint(0, 300)) + (common_part if k % 2 else other[: rng.randint(180, 230)]) + letter(rng.randint(0, 200))
        cut = rng.randrange(len(text))
        out.append(text if k % 3 else text[:cut] + "#" + text[cut:])
    return out + out[6:10] + [out[7]]


@pytest.mark.parametrize("group", [4096, 3])
def test_repeats(spark, monkeypatch, group):
    texts = repeat_cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = repeats.repeated
    monkeypatch.setattr(repeats, "repeated", lambda d, s, n: whole(d, s, n, group))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    want = brute_repeats([(t or "").encode() for t in texts], 200)
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "\x00\xff"])
def test_corpus_order(alphabet):
    """Suffix ranks of the dictionary and the sorted parse give the strings of each trigger in byte order, with who equals whom."""
    rng = random.Random(len(alphabet))
    letter = lambda n: bytes(rng.choice(alphabet.encode("latin-1")) for _ in range(n))
    shared = letter(420)
    texts = []
    for _ in range(60):
        a = rng.randrange(250)
        texts.append(letter(rng.randint(0, 90)) + shared[a : a + rng.randint(150, 420)] + letter(rng.randint(0, 90)))
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    groups = defaultdict(list)
    for part in repeats.parse(data, offsets):
        for of, lo, hi, at, trigger, _ in zip(*(x.tolist() for x in part)):
            groups[trigger].append((lo, hi, at, texts[of][lo : hi + 200]))
    seen = 0
    for entries in groups.values():
        entries = list({x[3]: x for x in entries}.values())  # distinct, as in the dictionary
        lo, hi, at = (np.array([x[k] for x in entries]) for k in range(3))
        entry, inner, equal = repeats.corpus_order(lo, hi, at, [x[3] for x in entries], 200)
        strings = [entries[e][3][i : i + 200] for e, i in zip(entry, inner)]
        assert strings == sorted(strings) and len(strings) == (hi - lo + 1).sum()
        assert equal.tolist() == [a == b for a, b in zip(strings, strings[1:])] + [False]
        seen += equal.sum()
    assert seen > 100


def test_spans_of_repeated_rows_stay_few(spark):
    text = repeat_cases()[6] * 3
    docs = repeats.keyed(spark.createDataFrame([(None, text)] * 300, "doc_id long, text string"), "doc_id", "text")
    store = common.Store(spark)
    spans = repeats.repeated(docs, store).groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("s")).select(F.size("s").alias("n")).collect()
    store.drop()
    assert len(spans) == 1 and spans[0].n <= len(text)


def test_long_text_is_parsed_in_parts(monkeypatch):
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(5000)), np.uint8)
    offsets = np.array([0, 5000])

    def starts(step):
        monkeypatch.setattr(repeats, "STEP", step)
        return [(p, t) for _, lo, hi, _, trigger, _ in repeats.parse(data, offsets) for a, b, t in zip(lo, hi, trigger) for p in range(a, b + 1)]

    assert starts(1 << 20) == starts(700) and len(starts(700)) == 5000 - 199


# -- personal data ------------------------------------------------------------------------


def brute_pii(text):
    out = []

    def luhn(n):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(n))) % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        n = re.sub("[^0-9]", "", m[0])
        if 14 <= len(n) <= 19 and luhn(n):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(6)
    pieces = ["a.b@c.de", "x@y", "@", "a@b.c_x@d.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-6789", "+", "é", "😀", " ", ".", "-", "00001.002.03.4", "token = \"abcdef0123456789\"", "12345678901234567890123", "\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(400)] + [" ".join(rng.choices(pieces, k=4000)), "a" * 30000 + "@", "1." * 20000, "+1" + " 2" * 20000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs).collect():
        want = brute_pii(texts[r.doc_id])
        assert [(b.start, b.rank, b.end, b.kind) for b in r.base] == want
        assert not any(a.start < b[2] and b[0] < a.end for a in r.added for b in want)


def test_phones_need_no_hyphen(spark):
    numbers = ["(212) 555 0147", "(212)555.0147", "212.555.0147", "212 555 0147", "212-555-0147", "(212) 555-0147", "212 555.0147"]
    texts = [f"call {n} now" for n in numbers] + ["call 212 5550147 now", "call 1212.555.0147.3 now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(c.kind, c.m, c.start) for c in r.cands if c.kind == "phone"] for r in pii.candidates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [[("phone", n, 5)] for n in numbers] + [[], []]


def test_reliabilities():
    """Expectation-maximisation finds who votes at random and recovers the truth from the others."""
    rng = random.Random(9)
    chance, truth, seen = [0.95, 0.9, 0.85, 0.9, 0.5], {}, Counter()
    for _ in range(6000):
        t = rng.random() < 0.4
        votes = tuple(0 if rng.random() < 0.2 else 1 if (rng.random() < c) == t else 2 for c in chance)
        seen[votes] += 1
        truth.setdefault(votes, Counter())[t] += 1
    post = pii.expectation_maximisation([("ip", v, n) for v, n in seen.items()])
    right = sum(truth[v][post["ip", v] > 0.5] for v in seen)
    assert right >= 0.995 * sum(max(c.values()) for c in truth.values())  # what one could do who knows the truth of each pattern


def test_added_spans(spark):
    """Of what only the wider patterns find, personal data are added and look-alikes are not."""
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    figures = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts, want = [], []
    for i in range(600):
        kind = i % 6
        span = {
            0: f"{word(5)}.{word(4)} [at] {word(6)} [dot] com", 1: f"({rng.randint(201, 989)}) 555-{figures(4)}", 2: f"token = \"{word(9)}{figures(7)}\"",
            3: f"{word(70)} (at) {word(8)}.org", 4: "", 5: f"{word(6)}@{word(5)}.com",
        }[kind]
        lead = {0: "contact", 1: "call", 2: "export", 3: "write"}.get(kind, "see")
        text = f"{word(7)} {word(3)} {lead} {span} {word(5)} {word(6)}"
        texts.append(text)
        want.append((text.index(span), text.index(span) + len(span)) if kind < 4 else None)
    got = {r.doc_id: [(a.start, a.end) for a in r.added] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hits = sum(w in got[i] for i, w in enumerate(want) if w)
    assert hits >= 0.9 * sum(w is not None for w in want)
    assert sum(len(got[i]) for i, w in enumerate(want) if not w) <= 2


# -- mixing -------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**64 - 1))
def test_permutation(n, key):
    x = mixing.permute(np.arange(n, dtype=np.uint64), np.full(n, n, np.uint64), np.full(n, key, np.uint64))
    assert sorted(x.tolist()) == list(range(n))


def test_targets_and_slots(spark):
    docs = table(spark, "documents")
    made = mixing.mix(docs, block=32)
    rows = made.sources.collect()
    size = {r.source: r.source_size for r in rows}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, capped = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    for r in rows:
        assert r.target == pytest.approx(3 * size[r.source] if r.source in capped else level * weight[r.source])
    slots = made.slots.collect()
    assert len({(s.shard, s.slot) for s in slots}) == len(slots) == sum(r.slots for r in rows)
    assert Counter(s.src for s in slots) == {r.src: r.slots for r in rows if r.slots}
    assert max(Counter((s.src, s.block, s["pass"]) for s in slots).values()) == 1
    taken = {r.doc_id: r for r in made.taken().collect()}
    texts = {r.doc_id: r for r in docs.collect()}
    by = Counter()
    for i, r in taken.items():
        assert r.taken <= 3 * r.size
        by[texts[i].source] += r.taken
    assert all(abs(by[r.source] - r.target) <= 1 for r in rows)
    mixed, shards = Counter(), defaultdict(set)
    for r in mixing.mixed_documents(docs, block=32, places=True).collect():
        mixed[r.doc_id] += len(re.findall(common.WORD, r.text))
        shards[r.shard].add(r.slot)
    assert all(mixed[i] == r.taken for i, r in taken.items())


def test_shards_are_multinomial_draws():
    """Counts by shard vary like draws, though their totals are the sources' slots exactly."""
    rows = [{"src": k, "source_size": 256 * n, "blocks": n, "full": n, "passes": 1, "rest": 0, "left": 0, "slots": n} for k, n in ((1, 3000), (2, 6001), (3, 99))]
    draws = mixing.Draws(rows, 64, 256, 7)
    drawn = sum(draws.draw(s) for s in range(draws.shards))
    draws.settle(drawn)
    ahead, seen, shares = np.zeros(3, np.int64), Counter(), []
    for s in range(draws.shards):
        slot, src, block, turn, take, part = draws.taken(s, ahead)
        ahead += draws.draw(s)
        assert sorted(slot) == list(range(draws.places(s))) and not part.any() and (take == 256).all()
        seen.update(zip(src.tolist(), block.tolist(), turn.tolist()))
        shares.append((src == 1).sum())
    assert len(seen) == 9100 and max(seen.values()) == 1
    p = 3000 / 9100
    assert 0.6 < np.var(shares[:-3]) / (64 * p * (1 - p)) < 1.5


def test_small_sources_meet_their_targets(spark):
    rng = random.Random(2)
    sizes = {"a": [100, 130], "b": [100], "c": [1], "d": [2, 3, 5], "e": [400, 599], "f": [7] * 30, None: [255, 1]}
    rows = [(s, " ".join(f"w{rng.randrange(99)}" for _ in range(n))) for s, ns in sizes.items() for n in ns]
    docs = spark.createDataFrame([(i if i % 3 else None, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    made = mixing.mix(docs)
    got = made.taken().groupBy("source_size", "target").agg(F.sum("taken").alias("n"), F.sum("size").alias("size")).collect()
    assert len(got) == len(sizes) and all(abs(r.n - r.target) <= 1 and r.size == r.source_size for r in got)
    words = sum(len(re.findall(common.WORD, r.text)) for r in mixing.mixed_documents(docs).collect())
    assert words == sum(r.n for r in got) and abs(words - sum(map(sum, sizes.values()))) <= 4


def test_mix_reruns_agree(spark):
    docs = table(spark, "documents")
    one, two = (sorted(map(tuple, mixing.mix(d).taken().collect())) for d in (docs, docs.repartition(7)))
    assert one == two


# -- packing ------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit(sizes):
    rows = packing.best_fit_decreasing(sizes, 64)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= 64 for r in rows)
    # the same rows as a plain search for the fullest row that has room
    free, plain = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(f, k) for k, f in enumerate(free) if f >= sizes[i]]
        if fits:
            k = min(fits)[1]
        else:
            free.append(64)
            plain.append(0)
            k = len(free) - 1
        free[k] -= sizes[i]
        plain[k] += sizes[i]
    assert sorted(plain) == sorted(sum(sizes[i] for i in r) for r in rows)


def test_packing_round_trip(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    got = defaultdict(dict)
    for r in packing.pack(table(spark, "documents"), length=256).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 256 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            got[r.doc_ids[k]][int(r.pieces[k].split("/")[0])] = ids[a:b]
    tok = packing.Tokenizer()
    assert {i: tok.decode(np.concatenate([p[k] for k in sorted(p)])) for i, p in got.items()} == {i: t or "" for i, t in docs.items()}


def test_long_runs_have_the_vocabularys_ids():
    tok = packing.Tokenizer()
    plain = " common words around it" * 500
    for text in ("a" * 50_000, "é" * 25_000 + " b " + "中" * 21_000, plain + " " + "x" * 20_001 + plain, plain + "q7" * 100_000 + plain):
        assert tok.encode(text)[:-1].tolist() == tok._load().encode_ordinary(text)
    space = plain + " " * 30_000 + "x\n\n" + "\t" * 25_000 + plain + "\x1c\u2003 \u3000" + " " * 22_000
    assert tok.encode(space)[:-1].tolist() == tok._load().encode_ordinary(space)
    assert tok.decode(tok.encode(" " * 1_200_000 + "x")) == " " * 1_200_000 + "x"


def test_files_beside_the_manifest_are_not_read(spark):
    docs = table(spark, "documents").limit(20).cache()
    uri = common.shared_path(spark, "t")
    want = packing.pack(docs, uri).count()
    path = uri.removeprefix("file:")
    name = next(p for p in __import__("os").listdir(path) if p.endswith(".npz"))
    __import__("shutil").copy(f"{path}/{name}", f"{path}/{name[:12]}-99999-7.npz")
    assert packing.read_packed(spark, uri).count() == want


# -- archives -----------------------------------------------------------------------------


def test_frames_and_errors():
    records = [warc.build_record(i, f"http://x/{i}", f"payload {i} ".encode() * (i % 50), None, False) for i in range(300)]
    data = warc.pack_archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    got = list(warc.read_archive(data))
    assert [r["payload"] for _, r in got] == [f"payload {i} ".encode() * (i % 50) for i in range(300)]
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(data[:-3]))
    with pytest.raises(warc.WarcError):
        warc.parse_record(records[7].replace(b"payload 7", b"payload 8", 1))
    with pytest.raises(warc.WarcError):
        warc.parse_record(records[7][:-4])
    with pytest.raises(warc.WarcError):
        warc.parse_record(records[7].replace(b"WARC-Date", b"WARC-Data"))


# -- decontamination ----------------------------------------------------------------------


#: A word, or a character of a script without spaces.
WORDS = r"[\u0e00-\u0eff\u3000-\u9fff]|(?:(?![\u0e00-\u0eff\u3000-\u9fff])[0-9A-Za-z\x80-\U0010ffff])+"


def brute_items(docs, items):
    def grams(t):
        w = re.findall(WORDS, t.translate(str.maketrans(common.UPPER, common.LOWER)))
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)

    have = [(i, *grams(t)) for i, t in items]
    runs = lambda t, k: {tuple(w[i : i + k]) for w in [re.findall(WORDS, (t or "").lower())] for i in range(len(w) - k + 1)}
    return {(d, i) for d, t in docs for i, g, n in have if n and len(g & (grams(t or "")[0] if n >= 5 else runs(t, n))) >= 0.8 * len(g)}


def test_decontamination(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == brute_items([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]) and got


def test_short_and_unspaced_items(spark):
    texts = ["Plan nine from outer space again", "quick brown", "yes", "four words in row", "北京是中国的首都吗", "", "...", None]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = ["the QUICK brown fox", "quick, brown!", "brown quick", "oh yes", "yesterday", "there are four words in row here", "four words row in", "据说北京是中国的首都吗？是", "北京不是中国首都", "", "plan nine from outer space again and again", None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, items).collect()}
    assert got == {(0, 1), (1, 1), (3, 2), (5, 3), (7, 4), (10, 0)} == brute_items(list(enumerate(docs)), [(i, t) for i, t in enumerate(texts) if t])


def test_blocks_do_not_change_scores(spark, monkeypatch):
    docs, items = table(spark, "documents"), table(spark, "benchmark").limit(60).cache()
    one = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    assert one and one == sorted(map(tuple, decontaminate.leaks(docs, items, index_items=8).collect()))  # more blocks than a task keeps


def test_wand_finds_all_above():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 12)))) for i in range(400)]
    index = decontaminate.Index(items, threshold=0.3)
    for _ in range(60):
        terms = np.array(sorted(rng.sample(range(len(index.vocab)), 15)))
        scores = np.zeros(len(index.ids))
        for t in terms:
            ids, impact, *_ = index.lists[t]
            scores[ids] += impact
        assert sorted(k for k, _ in index.wand(terms)) == np.flatnonzero(scores >= 0.3 - 1e-9).tolist()


def benchmarks():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    plain = [" ".join(rng.sample(words, rng.randint(9, 14))) for _ in range(88)]
    same = "one item that stands in the benchmark many times over and over"
    return {
        "equal": [same] * 3,
        "repeated": plain + [same] * 12,
        "templated": [f"what is {a} plus {b} and how did you find the sum of both" for a in ("four", "five", "six", "seven") for b in ("ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen")],
        "plain": plain,
    }


@pytest.mark.parametrize("postings", [1 << 20, 50])
@pytest.mark.parametrize("name", benchmarks())
def test_prefilter_loses_nothing(monkeypatch, name, postings):
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "POSTINGS", postings, raising=False)
    monkeypatch.setattr(decontaminate, "MIN_STRIDE", 20)
    texts, rng = benchmarks()[name], random.Random(8)
    vocab = sorted({w for t in texts for w in t.split()})
    docs = []
    for t in texts:
        w = t.split()
        w[rng.randrange(len(w))] = rng.choice(["changed", *vocab])
        for item in (t, " ".join(w)):
            docs.append(" ".join([*rng.choices(["x", "y", *vocab[:5]], k=rng.randint(0, 70)), item, *rng.choices("xyz", k=rng.randint(0, 50))]))
    items = list(enumerate(texts))
    got = {(d, i) for d, i, _ in decontaminate.found(decontaminate.Index(items), pa.array(docs))}
    assert {(d, i) for d, i in brute_items(list(enumerate(docs)), items) if texts[i] in docs[d]} <= got
    # all passages through WAND, without a prefilter
    index, want = decontaminate.Index(items), set()
    for d, text in enumerate(docs):
        h = decontaminate.words(text)
        for a in range(0, len(h), index.stride):
            part = h[a : a + 2 * index.stride]
            known = np.flatnonzero(np.isin(index.vocab, part))
            have = decontaminate.shingles(part)
            want |= {(d, index.ids[k]) for k, _ in index.wand(known) if max(np.isin(x, have).mean() for x in index.parts[k][:2]) >= index.overlap}
    assert got == want and {i for _, i in got} == set(range(len(texts)))


def test_question_and_answer():
    import pyarrow as pa

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, f"{prose(q)}. {prose(a)}.") for i, (q, a) in enumerate([(12, 2), (30, 1), (10, 30), (20, 12), (6, 20), (1, 29), (3, 8), (15, 4), (40, 10), (4, 4), (2, 3)])]
    items += [(11, prose(16)), (12, f"{prose(5)}\u00a0{prose(6)}.\u00a0{prose(7)}")]

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    def overlap(part, w):
        have = grams(part, k := min(5, len(part)))
        return len(have & grams(w, k)) / len(have) if have else 1.0

    split = lambda t: re.findall(WORDS, t.lower())
    docs, want = [], {}
    for i, t in items:
        q, a = decontaminate.question_answer(t)
        q, a = q.strip(), a.strip()
        near = " ".join([*q.split()[:-1], "changed"])
        for text in (t, q, a, f"{q} {word()} {a}", f"{a} {prose(9)} {q}", f"{q} {prose(len(a.split()))}", f"{near} {a}", f"{near} {prose(3)}", " ".join(q.split()[: len(q.split()) // 2]) + f" {a}"):
            docs.append(f"{prose(rng.randint(0, 90))} {text} {prose(rng.randint(0, 90))}")
    for d, text in enumerate(docs):
        w = split(text)
        for i, t in items:
            whole = split(t)
            n = len(split(decontaminate.question_answer(t)[0]))
            both, question, answer = (overlap(x, w) for x in (whole, whole[:n], whole[n:]))
            if both >= 0.8 or len(whole) >= 5 and question >= 0.8 and (answer >= 0.8 or n >= 5):
                want[d, i] = (question, answer)
    index = decontaminate.Index(items)
    got = {(d, index.ids[k]): r[1:] for d, k, r in decontaminate.found(index, pa.array(docs))}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert all((9 * i + 1, i) in got for i in range(5)) and not any((9 * i + 2, i) in got for i in range(5))


def test_words_are_hashed_alike():
    import pyarrow as pa

    texts = ["Über den Wolken, a1 b-2!", "", None, "x" * 5000, " a  b ", "A B"]
    flat = [(int(h), int(i)) for data, off in tokens.chunks(pa.array(texts)) for h, i in zip(*tokens.split(data, off)[2:])]
    alone = [(int(h), i) for i, t in enumerate(texts) for data, off in tokens.chunks(pa.array([t])) for h in tokens.split(data, off)[2]]
    assert flat == alone
    a, b = (decontaminate.words(t) for t in ("a b", "A,B!"))
    assert a.tolist() == b.tolist()


# -- models -------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    true = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language.identify(docs).collect() if r.held_out]
    assert np.mean([true[r.doc_id] == r.lang_pred for r in rows]) > 0.97


def test_quality_held_out(spark):
    docs, labels = (table(spark, n, "/root/testdata/sf0.01") for n in ("documents", "labels"))
    true = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.score, true[r.doc_id]) for r in quality.classify(docs, labels).collect() if r.held_out and r.doc_id in true]
    good, bad = ([s for s, y in rows if y == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_held_out_rows_teach_nothing(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01").where("lang in ('en', 'fr')")
    held = language.held_out(F.col("doc_id"))
    spoiled = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    one, two = (sorted(map(tuple, language.identify(d).collect()), key=str) for d in (docs, spoiled))
    assert one == two
