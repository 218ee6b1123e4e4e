import zlib
from collections import Counter
from math import exp, lgamma, log, log2, log10, pi

import numpy as np
from flowlens.llm import ctw, quality, toxicity
from flowlens.llm.bytegrams import Lookup, grams, log_gamma
from pyspark.sql import functions as F


def test_log_gamma():
    z = np.array([0.5, 1.0, 1.5, 3.0, 17.25, 1e6])
    assert np.allclose(log_gamma(z), [lgamma(x) for x in z])


def test_grams_hold_the_bytes_before():
    code, sizes = grams([b"ab", b""], 2, 10)
    assert sizes.tolist() == [3, 1]
    assert [int(c).to_bytes(3, "big") for c in code] == [b"\n\na", b"a\nb", b"ba\n", b"\n\n\n"]


class PlainTrees:
    """Context trees in dicts: counts by (context latest first, prefix), weights by the recursion, one decision at a time."""

    def __init__(self, bodies: list[bytes], depth: int):
        self.depth, self.counts, self.children, self.known = depth, {}, {}, {}
        for body in bodies:
            s = b"\n" * depth + body + b"\n"
            for i in range(depth, len(s)):
                prefix = 1
                for bit in range(7, -1, -1):
                    b = (s[i] >> bit) & 1
                    for d in range(depth + 1):
                        ctx = bytes(reversed(s[i - d : i]))
                        self.counts.setdefault((ctx, prefix), [0, 0])[b] += 1
                        if d < depth:
                            self.children.setdefault((ctx, prefix), set()).add(s[i - d - 1])
                    prefix = 2 * prefix + b

    def own(self, node) -> float:
        z, o = self.counts[node]
        return lgamma(z + 0.5) + lgamma(o + 0.5) - lgamma(z + o + 1) - log(pi)

    def mixed(self, node) -> tuple[float, float]:
        """ln of the weighted probability, and the weight of the node's own estimate."""
        if node not in self.known:
            own = self.own(node)
            if len(node[0]) == self.depth:
                self.known[node] = own, 1.0
            else:
                below = sum(self.mixed((node[0] + bytes([c]), node[1]))[0] for c in self.children[node])
                most = max(own, below)
                total = most + log(exp(own - most) + exp(below - most)) - log(2)
                self.known[node] = total, exp(own - log(2) - total)
        return self.known[node]

    def one(self, past: bytes, prefix: int, d: int = 0, last: float = 0.5) -> float:
        """Probability of a one after `past`, latest first."""
        node = past[:d], prefix
        if d > self.depth or node not in self.counts:
            return last
        z, o = self.counts[node]
        w, p = self.mixed(node)[1], (o + 0.5) / (z + o + 1)
        return w * p + (1 - w) * self.one(past, prefix, d + 1, p)

    def log10(self, body: bytes) -> float:
        s, total = b"\n" * self.depth + body + b"\n", 0.0
        for i in range(self.depth, len(s)):
            past, prefix = bytes(reversed(s[i - self.depth : i])), 1
            for bit in range(7, -1, -1):
                b, p = (s[i] >> bit) & 1, self.one(past, prefix)
                total += log10(p if b else 1 - p)
                prefix = 2 * prefix + b
        return total


def _mixture(spark, rows, **options):
    got = {r["doc_id"]: r for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    bodies = {i: b" ".join((t or "").encode().lower().split()) for i, t in rows}
    plain = PlainTrees([b for i, b in bodies.items() if zlib.crc32(str(i).encode()) % 7 != 2], ctw.DEPTH)
    for i, body in bodies.items():
        want = plain.log10(body)
        assert abs(got[i]["score"] - want) < 1e-6 * abs(want), (i, got[i]["score"], want)
        assert got[i]["n_bytes"] == len(body) + 1
    return got


def test_scores_are_the_mixture_of_plain_loops(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if not r["text"] or len(r["text"]) < 900][:70] + [(900 + k, t) for k, t in enumerate(("ZZZZ qqqq \u4e2d\u6587", "a" * 500, "\x00\x01 \x7f"))]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    assert len(held) > 3
    # all grams sent out, and nearly none
    assert _mixture(spark, rows).keys() == _mixture(spark, rows, broadcast=50).keys()


def test_probabilities_add_up():
    data = [b"one two three two one", b"three three one"]
    code, n = np.unique(grams(data, ctw.DEPTH, 10)[0], return_counts=True)
    for past in (code[0], code[-1], np.uint64(0x7A7A7A7A7A7A00)):
        every = (past & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        met = np.union1d(code, every)
        learnt = np.zeros(len(met), dtype=np.int64)
        learnt[np.searchsorted(met, code)] = n
        found, tops = ctw.trees(met, learnt)
        logs = ctw.Top(*tops).log2(met, found)
        assert abs((2 ** logs[np.isin(met, every)]).sum() - 1) < 1e-9


def test_lookups_find_every_gram():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 56, 5000, dtype=np.uint64))
    for some in (keys, keys[:1], keys[:0]):
        found = Lookup(some, np.arange(len(some), dtype=np.float32))(keys)
        assert np.array_equal(found[: len(some)], np.arange(len(some))) and np.isnan(found[len(some) :]).all()


def test_scores_match_brute_force(docs, plain):
    got = {r["doc_id"]: r for r in ctw.score(docs).collect()}
    assert len(got) == len(plain)
    tokens = {i: [*t.encode().lower().split(), ctw.END] for i, t in plain.items()}
    counts = Counter(w for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ts)
    total, distinct = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(ts), sum(counts[w] > 0 for w in ts))
        assert abs(r["base_score"] - sum(log10((counts[w] + 1) / (total + distinct + 1)) for w in ts)) < 1e-6
        assert r["score"] < 0
    # contexts help: held-out texts take far fewer bits than by how often each byte occurs
    bodies = {i: b" ".join(ts[:-1]) + ctw.END for i, ts in tokens.items()}
    seen = Counter(b for i, body in bodies.items() if not got[i]["held_out"] for b in body)
    held = [i for i in bodies if got[i]["held_out"]]
    plainly = sum(-log2((seen[b] + 1) / (seen.total() + 256)) for i in held for b in bodies[i])
    assert sum(got[i]["bits"] for i in held) < 0.75 * plainly
    assert all(got[i]["n_bytes"] == len(body) for i, body in bodies.items())


def test_text_counts_match_plain_loops(plain):
    for t in plain.values():
        words = t.encode().split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        got = dict(zip(quality.COUNTS, quality.text_counts(t), strict=True))
        assert got["n_words"] == len(words) and got["n_repeat_words"] == len(covered)
        assert got["word_chars"] == sum(len(w.decode()) for w in words)
        assert got["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>") and got["n_dup_lines"] == len(lines) - len(set(lines))


def test_outliers_go_and_clean_texts_stay(docs, plain):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert len(got) == len(plain)
    for i, t in plain.items():
        if len(t.split()) < 50 and not t.startswith("%"):
            assert got[i]["base_failed"] and not got[i]["kept"]
    symbols = next(i for i, t in plain.items() if t.startswith("%"))
    assert not got[symbols]["kept"]
    assert all(got[i]["kept"] for i in range(60))


def test_a_third_to_nearly_half_junk_of_one_kind_goes(spark):
    import random

    from conftest import prose

    rng = random.Random(11)
    rows, junk = [], set()
    for lang, source, share in (("en", "web", 0.45), ("en", "books", 0.0), ("fr", "web", 0.30), ("fr", "books", 0.0)):
        for i in range(200):
            if i < 200 * share:
                junk.add(len(rows))
                text = " ".join(rng.choice(["BUY", "$NOW!", "$$$", "FREE", "#WIN!!"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(60, 160)))
            else:
                text = prose(rng, rng.randint(60, 160))
            rows.append((len(rows), text, lang, source))
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and not any(got[i]["base_failed"] for i in got)
    assert {i for i in got if not got[i]["kept"]} == junk


def test_small_groups_are_not_rejected_by_noise(spark):
    import random

    from conftest import prose

    rng = random.Random(3)
    rows = []
    for n in range(1, 11):
        rows += [(100 * n + i, prose(rng, rng.randint(60, 160)), f"l{n}", "s") for i in range(n)]
    # one row more that repeats a key, one without key, lang and source, one without text
    rows += [(100, prose(rng, 80), "l1", "s"), (None, prose(rng, 90), None, None), (None, None, None, "s")]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50) and r["kept"] == (not r["base_failed"])
        assert r["distance"] is None if r["base_failed"] else 0 <= r["distance"] < quality.REACH


def test_distances_are_those_of_the_estimate(spark):
    # one language and source: the reweighted estimate is the mean and covariance of rows that agree with a raw one
    import random

    from conftest import prose

    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(60, 200)), "en", "web") for i in range(150)] + [(500 + i, "BUY$ NOW! " * 20 + prose(rng, 60), "en", "web") for i in range(20)]
    plain = {i: quality.statistics(quality.text_counts(t)) for i, t, *_ in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["distance"] for r in quality.judge(frame).collect() if not r["base_failed"]}
    x = np.array([plain[i] for i in sorted(got)])
    raw = min((quality.concentrate(x, d) for d in ((((x - c) / np.maximum(x.std(axis=0), 1e-3)) ** 2).sum(axis=1) for c in x)), key=lambda e: e[0])
    off = x - raw[1]
    near = np.einsum("ij,ij->i", off @ np.linalg.inv(raw[2]), off) <= quality.AGREES
    mean, cov = x[near].mean(axis=0), quality._floored(quality.AGREES_SHRUNK * np.cov(x[near], rowvar=False, bias=True))
    off = x - mean
    want = np.einsum("ij,ij->i", off @ np.linalg.inv(cov), off)
    mine = np.array([got[i] for i in sorted(got)])
    assert ((mine > quality.REACH) == (want > quality.REACH)).all()
    clean = np.array([i < 500 for i in sorted(got)])
    assert np.allclose(mine[clean], want[clean], rtol=0.35, atol=1.0)


def test_quality_of_an_empty_table(empty):
    assert quality.judge(empty).count() == 0 and ctw.score(empty).count() == 0


def test_toxic_words_are_learnt(spark):
    import random

    rng = random.Random(5)
    base = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter") for b in ("an", "sol", "vi", "dra", "pe")]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(base) for _ in range(60)]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vile", "vilest", "vilely", "scoundrel"])
        rows.append((i, " ".join(words)))
        if i % 10 < 8:
            labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, "")]
    labels += [(7, None), (9999, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, known).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    truth = {i: any(w.startswith(("vile", "scoundrel")) for w in t.split()) for i, t in rows if t}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in truth)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95
    # the likelihoods, by plain loops over the texts that counts are taken from
    label = {i: y for i, y in labels if y is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    taught = {(t or "", label[i]) for i, t in rows if i in label}
    plain = PlainKneser([(toxicity.words(t), y) for t, y in taught])
    for i, t in rows:
        now = toxicity.words(t or "")
        want = sum(log(1 - toxicity.SHARE + toxicity.SHARE * plain.word(w, 1) / plain.word(w, 0)) for w in now) / max(1, len(now))
        assert abs(got[i]["ratio"] - want) < 1e-9 and got[i]["n_words"] == len(now)
    one = toxicity.score(docs, known.where("toxic = 0")).select("score").distinct().collect()
    assert [r["score"] for r in one] == [0.0]


class PlainKneser:
    """Continuation counts in sets of the words before; discount, beginnings and shared counts as the operator says."""

    def __init__(self, texts):
        self.before = {}
        for words, y in texts:
            for a, w in zip(["\n", *words], words, strict=False):
                for level, x in ((0, w), (1, w[: toxicity.BEGINNING])):
                    for c in (y, "both"):
                        self.before.setdefault((level, c), {}).setdefault(x, set()).add(a)

    def n(self, level, c, x):
        return len(self.before[level, c].get(x, ()))

    def level(self, level, c, x, lower):
        every = sum(len(v) for v in self.before[level, c].values())
        free = sum(min(len(v), toxicity.DISCOUNT) for v in self.before[level, c].values())
        return (max(self.n(level, c, x) - toxicity.DISCOUNT, 0) + free * lower) / every

    def word(self, w, c):
        b = w[: toxicity.BEGINNING]
        shared = self.before[1, "both"]
        start = self.level(1, c, b, (self.n(1, "both", b) + 1) / (sum(map(len, shared.values())) + len(shared) + 1))
        return self.level(0, c, w, start * min(1, (self.n(0, "both", w) + 1) / (self.n(1, "both", b) + 1)))


def test_toxicity_without_labels_texts_or_keys(spark, empty):
    schema = "doc_id long, text string, toxic int, ratio double, _text string, _y int"
    docs = spark.createDataFrame([(1, "a b", 1, 0.5, "x", 2), (1, "c d e", 0, 0.5, "x", 2), (None, "a", 0, None, None, None), (4, None, 0, 1.0, "", 0)], schema)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(empty, none).count() == 0
    # labels of both classes whose texts are not there
    absent = spark.createDataFrame([(i, i % 2) for i in range(100, 140)], "doc_id long, toxic int")
    for labels, score in ((none, 0.0), (absent, None)):
        got = toxicity.score(docs, labels).collect()
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "4", "None"]
        assert len({r["score"] for r in got}) == 1 and (score is None or got[0]["score"] == score)
    # with a model: clashing names, repeated and missing keys are scored each
    taught = spark.createDataFrame([(i, "vile words " * 20 if i % 2 else "good words " * 20) for i in range(200)], "doc_id long, text string")
    both = taught.select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in (("toxic", "int"), ("ratio", "double"), ("_text", "string"), ("_y", "int"))]).unionByName(docs)
    got = toxicity.score(both, spark.createDataFrame([(i, i % 2) for i in range(5, 200)], "doc_id long, toxic int")).collect()
    assert len(got) == 204 and sum(r["n_words"] for r in got if r["doc_id"] is None) == 1
