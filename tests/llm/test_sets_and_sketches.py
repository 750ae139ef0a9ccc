"""Search, url rules, chat, mixing, sketches and near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import chat, components, iblt, mixing, probminhash, urlrules, vafile


def _topk(rows, k):
    ok = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        scored = sorted({(-sum(a * b for a, b in zip(x, y)), c, y) for i, x in ok if i == q for c, y in ok if c != q and len(y) == len(x)})
        out += [(q, r, c, -s) for r, (s, c, _) in enumerate(scored[:k], 1)]
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vafile, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.choice([-0.5, 0.25, 0.1, 0.9, -1.0], 6)]) for i in range(300)]
    rows += [(400, None), (420, [float("nan")] * 6), (440, [None] * 6), (460, [float("inf")] * 6), (480, [1.0, 2.0]), (481, [3.0, 1.0]), (None, [1.0] * 6), rows[3], rows[20], (500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    found = vafile.top_k(df, df.where("vec_id % 20 = 0"), 20)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == sorted(_topk(rows, 20))
    assert vafile.top_k(df.limit(0), df.limit(0)).collect() == []


def test_large_components_are_exact(spark):
    big = [(0, [4e6, 1.0]), (1, [3e6, 0.0]), (2, [5e6, 0.0]), (20, [2.0**51, -(2.0**50)]), (21, [2.0**50, 2.0**51 + 1])]
    found = vafile.top_k(spark.createDataFrame(big[:3], "vec_id long, embedding array<double>"), spark.createDataFrame(big[:1], "vec_id long, embedding array<double>"))
    assert [(r.vec_id, r.score) for r in found.orderBy("rank").collect()] == [(2, 81920000000000000), (1, 49152000000000000)]
    small = [(i, [x / 2.0**48 for x in v]) for i, v in big[3:]]
    rows = [(i, [2.0**20 * x + 1 for x in v]) for i, v in [*small, *((40 + j, [float(j % 7 - 3), float(j % 5)]) for j in range(90))]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vafile.top_k(df, df.where("vec_id % 20 = 0"), 20).collect())
    assert got == sorted(_topk(rows, 20))
    over = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond the range of a long"):
        vafile.top_k(over, over).collect()
    with pytest.raises(Exception, match="beyond a long"):
        vafile.top_k(over.selectExpr("vec_id", "array(1e300D) AS embedding"), over).collect()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for top in (70, 3, 1 << 40):
        m, q = rng.integers(-top, top, (200, 8)), rng.integers(-top, top, (5, 8))
        cells, last = vafile.approximate(m)
        d = np.arange(8)[None, :]
        assert (m <= last[d, cells]).all() and (np.where(cells > 0, last[d, np.maximum(cells, 1).astype(int) - 1], m - 1) < m).all()
        bounds = vafile.upper_bounds(q, cells, last, m.min(axis=0))
        assert all(float(sum(int(a) * int(b) for a, b in zip(q[i], m[j]))) <= bounds[i, j] for i in range(5) for j in range(200))


def _rule(url, rules=urlrules.RULES):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c.lower() if "A" <= c <= "Z" else c
    path = rest[len(host) :].split("?")[0].split("#")[0]
    fits = [r for r, _ in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len, default=None)


def test_rules_and_mined_verdicts(spark):
    urls = [f"https://{'WWW' if i % 2 else 'm'}.site{i % 5}.Example.{'com' if i % 3 else 'net'}/{'en' if i % 4 else 'de'}/{i}?a=1#x" for i in range(400)]
    urls += [f"http://m.site1.example.org/en/{i}" for i in range(50)]
    urls += [None, "", "no scheme", "http://", "x://h", "://?q", "http://a.com", "https://evilcom/en/1", "http://com/en/", "http://é.COM/en/\nx", "http://h/" + "a" * 50_000, urls[0]]
    pages = spark.createDataFrame([*enumerate(urls), (None, urls[1])], "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = urlrules.judge(pages).collect()
    assert len(rows) == len(urls) + 1
    verdicts = dict(urlrules.RULES)
    for r in rows:
        host, path, rule = _rule(urls[r.page_id if r.page_id is not None else 1])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdicts[rule] if rule else r.verdict in ("allow", "block")
    # .org was never labelled here, but en urls of .com were blocked (those with 7 were not)
    mined = {r.verdict for r in rows if r.rule is None and r.host == "m.site1.example.org" and not r.path.startswith("/en/7")}
    assert mined == {"block"}
    assert urlrules.judge(pages.limit(0)).collect() == []


def test_rules_are_mined_on_whole_deeper_folders(spark):
    rows = [(i, f"http://a{i % 9}.com/en/{'spam' if i % 2 else 'safe'}/x{i % 7}") for i in range(200)]
    rows += [(1000 + i, f"http://b{i}.org/a/{'spam' if i % 2 else 'safe'}/x{i % 7}") for i in range(40)]
    rules = [("com/en/spam", "block"), ("com/en/safe", "allow")]
    found = {r.page_id: r for r in urlrules.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert all(found[i].rule is None and found[i].verdict == ("block" if i % 2 else "allow") for i in range(1000, 1040))


def test_templates_of_many_folders_are_mined_in_time(spark):
    folders = "/".join(f"{c}folder" for c in "abcdefghijklmno")
    rows = [(i, f"http://www.shop.example.com/en/{folders}/x{i}") for i in range(100)]
    rows += [(200 + i, f"http://m{i % 5}.example.com/{'en' if i % 2 else 'fr'}/y{i}") for i in range(150)]
    rows += [(500, "http://other.org/dfolder"), (501, f"http://other.org/zz/{folders}"), (502, "http://other.org/zz")]
    rules = [("com/en/", "block"), ("com/fr/", "allow")]
    found = {r.page_id: r for r in urlrules.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert [found[i].verdict for i in (0, 200, 201)] == ["block", "allow", "block"]
    # a whole template elsewhere is blocked; no labelled url had the other tokens at their places
    assert found[501].verdict == "block" and found[502].verdict == urlrules.DEFAULT
    labelled = spark.createDataFrame([(["a", "b", "c"], "block"), (["a", "b"], "allow"), (["a", "b", "c"], "block"), (["d", "c"], "allow")], "tokens array<string>, verdict string")
    assert {(r.token, r.stands) for r in urlrules.together(labelled, 0.5).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_of_rules_of_equal_length_the_last_by_text_wins(spark):
    rules = [("com/e/f", "allow"), ("b.com/e", "block")]
    row = urlrules.judge(spark.createDataFrame([(1, "http://b.com/e/f")], "page_id long, url string"), rules).first()
    assert (row.rule, row.verdict) == ("com/e/f", "allow")


def test_verdicts_equal_brute_force_mining(spark):
    rng = random.Random(8)
    url = lambda: f"http://{rng.choice(['www.', 'm.', ''])}{rng.choice('pqr')}.{rng.choice(['com', 'net'])}/{rng.choice(['en', 'fr'])}/{rng.choice(['aa', 'ab', 'cc'])}?{rng.choice(['k=1', 'l=2', ''])}"
    rows = [(i, url()) for i in range(300)]
    rules = [("p.com/en/a", "block"), ("q.net/", "allow"), ("m.r.com/", "block")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    host, path = urlrules.host_of(F.col("url")), urlrules.path_of(F.col("url"))
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", urlrules.url_tokens(F.col("url"), host, path).alias("t")).collect()}
    found = {r.page_id: r for r in urlrules.judge(pages, rules, min_support=0.2).collect()}
    given = {i: found[i].verdict for i in found if found[i].rule}
    items = sorted({t for i in given for t in tokens[i]})
    n, best = len(given), {}
    frequent = [frozenset()]
    while frequent:
        level = {s | {t} for s in frequent for t in items if t not in s}
        frequent = [s for s in level if sum(s <= tokens[i] for i in given) >= 0.2 * n]
        for s in frequent:
            for verdict in ("allow", "block"):
                both, all_of = sum(s <= tokens[i] and given[i] == verdict for i in given), sum(s <= tokens[i] for i in given)
                if both >= 0.2 * n and both / all_of >= urlrules.MIN_CONFIDENCE:
                    best[s, verdict] = (both / all_of, both / n, -len(s), verdict)
    for i, r in found.items():
        if not r.rule:
            fired = [v for (s, _), v in best.items() if s <= tokens[i]]
            assert r.verdict == (max(fired)[3] if fired else urlrules.DEFAULT), (r, sorted(tokens[i]))


def test_inverted_index_fires_only_whole_rules(spark):
    rules = spark.createDataFrame([(1, ["a", "b"], "block", 0.9, 0.5), (2, ["a"], "allow", 0.7, 0.5), (3, ["c", "d"], "block", 1.0, 0.5)], "rule_id long, tokens array<string>, verdict string, confidence double, support double")
    sets = spark.createDataFrame([(["a"],), (["a", "b", "c"],), (["c"],)], "tokens array<string>")
    got = {tuple(r.tokens): r.mined for r in urlrules.match(sets, rules).collect()}
    assert got == {("a",): "allow", ("a", "b", "c"): "block"}


CONTROL = ["<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "x", "|>", "é", "\n"]), max_size=10).map("".join))
def test_escapes_are_reversible_and_hide_control_strings(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in CONTROL)
    piece = f"{chat.TURN}user{chat.TEXT}{safe}{chat.END}"
    assert chat._piece.findall(piece) == [("user", safe)]


def test_unknown_layouts_are_reported_and_empty_tables_pass(spark):
    records = spark.createDataFrame([('{"id": 1, "prompt": "a", "response": "b"}',), ('{"id": 1, "prompt": "a", "response": "b"}',), ('{"z": 1}',), ("nope",), (None,), ("",)], "record string").withColumn("layout", F.lit("clash"))
    report = {(r.known, r.layout == "invalid"): r.n for r in chat.layout_report(records).collect()}
    assert report == {(True, False): 2, (False, False): 1, (False, True): 3}
    assert chat.canonical_turns(records).count() == 4
    none = chat.canonical_turns(records.limit(0))
    assert none.collect() == [] and chat.read_back(chat.format_turns(none)).collect() == []
    rows = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", "x" * 300_000), (None, 0, "assistant", "y"), (1, 1, "assistant", "x" * 300_000)], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(chat.conversation_records(rows)))).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 600_000 and out[None].loss_chars == 1


def test_layouts_become_one_kind_of_turns():
    same = [(7, "user", "Hi"), (7, "assistant", "Yo")]
    records = [
        '{"id": 7, "messages": [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Yo"}]}',
        '{"conversations": [{"from": "human", "value": "Hi"}, {"from": "gpt", "value": "Yo"}], "id": 7}',
        '{"id": 7, "prompt": "Hi", "completion": "Yo"}',
        '{"id": 7, "instruction": "Hi", "input": "", "output": "Yo"}',
    ]
    for r in records:
        assert [(c, role, t) for c, _, role, t in chat.turns_of(r)[1]] == same
    assert len({chat.turns_of(r)[0] for r in records}) == 4
    assert chat.turns_of("nope") == ("invalid", []) and chat.turns_of(None) == ("invalid", []) and chat.turns_of('{"z": 1}')[1] == []


def test_conversations_round_trip(spark):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a\\"), (2, 0, "system", None), (2, 1, "user", ""), (3, None, None, "x" * 100_000), (None, 0, "assistant", "n"), (1, 2, "assistant", "é"), (1, 2, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("layout", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(chat.conversation_records(df)))).collect()}
    expect = defaultdict(list)
    for c, t, role, text in rows:
        expect[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(expect)
    for c, turns in expect.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[c].n_turns == len(turns)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_mixture_meets_its_budgets(spark):
    rng = random.Random(4)
    rows = [(i, "big" if i % 3 else f"s{i % 4}", " ".join(["w"] * rng.randint(1, 60))) for i in range(3000)]
    rows += [(9000, None, "a b c"), (9001, "void", ""), (9002, "void", None), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("epoch", F.lit("clash"))
    tokens = Counter()
    for _, s, t in rows:
        tokens[s] += len((t or "").split())
    total = sum(tokens.values())
    drawn = mixing.mix(docs, repeats=1.5, block=64).collect()
    got = Counter()
    for r in drawn:
        got[r.source] += r.tokens
    share = {s: n / total for s, n in tokens.items() if n}
    # plain bisection
    low, high = 0.0, 1.0
    most = lambda a: max(share[s] ** a / sum(p**a for p in share.values()) * total / tokens[s] for s in share)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if most(mid) <= 1.5 else (mid, high)
    z = sum(p**high for p in share.values())
    for s, p in share.items():
        budget = p**high / z * total
        assert budget - 61 <= got[s] <= budget + 1, s
    copies = Counter((r.doc_id, r.epoch) for r in drawn if r.doc_id != 1)
    assert max(copies.values()) == 1
    assert mixing.mix(docs.limit(0)).collect() == []


def _hash(*values):
    """Spark's xxhash64: each value hashed with the hash so far as the seed; (value, "i") is a 32-bit one, None changes nothing."""
    import struct

    import xxhash

    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed & (2**64 - 1))
            seed -= (seed >> 63) << 64
    return seed


def _mixture(docs, ratio, repeats, seed, block):
    """Restates the mixture document by document: [(doc_id, source, epoch)]."""
    rows = [(i, s, _hash(t), len((t or "").split())) for i, t, s in docs]
    src = {s: ("-" if s is None else "+") + (s or "") for _, s, _, _ in rows}
    total = {s: sum(r[3] for r in rows if r[1] == s) for s in src}
    available = sum(total.values())
    share = {s: n / available for s, n in total.items() if n}

    def most(a):
        z = sum(x**a for x in share.values())
        return max(ratio * x ** (a - 1) / z for x in share.values())

    low, high = -1, 2**25
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if most(mid / 2**25) <= repeats + 1e-12 else (mid, high)
    a = high / 2**25
    z, out = sum(x**a for x in share.values()), []
    for s, x in share.items():
        budget = int(x**a / z * ratio * available + 1e-6)
        own = [r for r in rows if r[1] == s]
        passes, rest = divmod(budget, total[s])
        blocks = -(-len(own) // block)
        out += [(r[0], s, e) for r in own for e in range(passes)]
        order = sorted(own, key=lambda r: (_hash((seed + 2, "i"), src[s], _hash((seed + 1, "i"), r[0], r[2]) % blocks), _hash((seed, "i"), r[0], r[2]), r[0], r[2]))
        for r in order:
            rest -= r[3]
            if rest < 0:
                break
            out.append((r[0], s, passes))
    return out


@pytest.mark.parametrize(("ratio", "repeats", "block"), [(1.0, 1.25, 4096), (1.0, 1.5, 16), (2.3, 4.0, 7), (0.4, 1.25, 5)])
def test_mixture_equals_a_plain_restatement(spark, ratio, repeats, block):
    """Which documents, blocks and epochs are drawn. Documents have tokens, so that a block's end is the same in both."""
    rng = random.Random(int(ratio * 10) + block)
    docs = [(i, " ".join(["word"] * rng.randint(1, 30)) + f" {i}", rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(frame, budget_ratio=ratio, repeats=repeats, seed=42, block=block).collect()
    assert sorted(((r.doc_id, r.source or "", r.epoch) for r in got)) == sorted((i, s or "", e) for i, s, e in _mixture(docs, ratio, repeats, 42, block))


def test_entropy_target(spark):
    rows = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "src string, share double")
    a = mixing.exponent_for(rows, 1.0, 1.0, None)
    w = np.array([0.7, 0.2, 0.1]) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(1.0, abs=1e-4)
    assert mixing.exponent_for(rows, 1.0, 0.1, None) == 1.0 and mixing.exponent_for(rows, 1.0, 2.0, None) == 0.0


def test_peeling_recovers_every_difference(spark):
    rng = random.Random(6)
    rows = []
    for i, (n, own) in enumerate([(5, 1), (40, 0), (0, 3), (200, 150), (0, 0), (3, 1000)]):
        shared = [rng.getrandbits(63) for _ in range(n)]
        rows.append((i, shared + [rng.getrandbits(63) for _ in range(own)], shared + [rng.getrandbits(63) for _ in range(own // 2)]))
    pairs = spark.createDataFrame(rows, "k int, left array<long>, right array<long>")
    got = {r.k: r.near for r in iblt.likeness(pairs, ["k"]).collect()}
    for k, a, b in rows:
        assert got[k] == pytest.approx(2 * len(set(a) & set(b)) / (len(a) + len(b)) if a or b else 1.0)


def test_fingerprints_of_whole_documents(spark):
    rng = random.Random(7)
    text = lambda n: "\n".join(" ".join(rng.choice("alpha beta gamma delta eps".split()) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 40))) for _ in range(n))
    rows = [(i * 3, text(rng.randint(1, 9))) for i in range(60)] + [(500, None), (501, ""), (502, "é🎉ab" * 30_000), (503, "tie"), (503, "tie"), (600, rows0 := text(4)), (601, rows0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("clash"))
    got = iblt.compare(docs).collect()
    assert len(got) == len(rows)
    ordered = sorted((i, t or "") for i, t in rows)
    expect = Counter()
    for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        expect[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expect
    by = {r.doc_id: r for r in got}
    assert by[600].fingerprint == by[601].fingerprint and by[600].near_next == 1.0 and by[500].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert np.mean([r.near_edited for r in got if r.doc_id < 180]) > 0.5 > np.mean([r.near_next for r in got if r.doc_id < 180])
    assert iblt.compare(docs.limit(0)).collect() == []


def _similarity(a: str, b: str) -> float:
    def bag(t):
        w = t.split()
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()

    x, y = bag(a), bag(b)
    if not x or not y:
        return float(x == y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def _classes(rows):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if root(i) != root(j) and _similarity(a or "", b or "") >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "BLOCK", 4)
    monkeypatch.setattr(probminhash, "SPREAD", 3)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    shared = [word() for _ in range(60)]
    rows += [(n + i, " ".join([*shared, *(word() for _ in range(40))])) for i in range(15)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one two"), (905, "one two three"), (906, "loop " * 5000), (907, "loop " * 5000)]
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[1][1])], "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    found = probminhash.classes(docs).collect()
    assert len(found) == len(rows) + 2
    assert {r.doc_id: r.class_id for r in found} == {**_classes(rows), None: None}
    kept = probminhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(_classes(rows).values()))
    assert probminhash.classes(docs.limit(0)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=25).map(" ".join), st.lists(st.sampled_from("abcd"), min_size=1, max_size=25).map(" ".join))
def test_probability_jaccard_is_exact(a, b):
    got = probminhash.probability_jaccard(probminhash.shingles(a, {}), probminhash.shingles(b, {}))
    assert got == pytest.approx(_similarity(a, b))


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = rng.integers(1, 5, 300), rng.integers(1, 5, 300)
    a, b = (np.sort(elements[:300]), wa), (np.sort(elements[100:]), wb)
    exact = probminhash.probability_jaccard(a, b)
    near = (probminhash.signature(*a, 4000) == probminhash.signature(*b, 4000)).mean()
    assert near == pytest.approx(exact, abs=0.03)
    assert set(probminhash.signature(*a)) <= set(a[0])


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in parent}


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_neighbours_in_ranges_of_any_size(spark, size):
    """Every row's next is the following one by id, round the end; one id's rows and null ids may lie in several ranges."""
    rows = [(None, "n1"), (None, None), (3, "c"), (3, "c"), (3, "a"), (5, "x"), (9, ""), (-4, "neg")]
    rows += [(7, f"t{i}") for i in range(40)] + [(100 + i, f"u{i}") for i in range(60)]
    found = iblt.neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size).collect()
    found.sort(key=lambda r: (r["range"], r.place))
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in found]
    assert ids == sorted((d is not None, d or 0) for d, _ in rows)
    assert sorted(r.text for r in found) == sorted(t or "" for _, t in rows)
    assert [r.next_text for r in found] == [r.text for r in found[1:] + found[:1]]
    if size == 1:
        assert len({r["range"] for r in found if r.doc_id == 7}) > 1
