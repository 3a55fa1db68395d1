"""Each operator against brute force on small tables, and on odd ones: nulls, empty tables, repeated rows, clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from schemaweave.llm import brown, chat, exact, langid, linedup, minhash, mixing, packing, quality, queries, rules, store

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, key string, size int, kept boolean, target double, score double"
VOCAB = {"en": "the of and to stone river house green walk under light north".split(), "de": "der die und zu stein fluss haus grün gehen unter licht norden".split()}


def words(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang]) + rng.choice(["", "", "s", "en", "x"]) for _ in range(n))


def rows(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(["en", "de"])
        text = "\n".join(words(rng, lang, rng.randint(3, 40)) for _ in range(rng.randint(1, 4)))
        out.append([k, text, lang, f"src{k % 4}", len(text)])
    for k in range(0, 12, 2):
        out.append([n + k, out[k][1].replace(" ", "  ", 3), out[k][2], None, 0])  # equal but for white space
        parts = out[k + 1][1].split(" ")
        parts[len(parts) // 2] = "changed"
        out.append([n + k + 1, " ".join(parts), out[k + 1][2], "src0", 0])
    out += [[900, None, None, None, None], [901, "", "en", "src1", 0], [902, " \t\n ", None, "src1", 3], [903, "12345 !!!", "en", "src9", 9], [None, "no id here at all", "en", "src9", 0]]
    out += [out[0], out[0]]  # rows repeated as a whole
    out.append([904, words(rng, "en", 30_000), "en", "src2", 0])
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + [7, "r", "k", 1, True, 0.5, 0.5] for r in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(text):
    return b" ".join((text or "").encode().split(b"\x1f")) if False else (text or "")


def squeeze(text):
    out, white = [], False
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if not white:
                out.append(" ")
            white = True
        else:
            out.append(c)
            white = False
    return "".join(out)


def shingles(text, n=5):
    w = [x for x in squeeze(text).lower().split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[squeeze(r.text)].append(r.doc_id)
    got = exact.deduplicate(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert len(by) == len(groups)
    for text, ids in groups.items():
        rs = by[hashlib.sha256(text.encode()).hexdigest()]
        low = min([i for i in ids if i is not None], default=None)
        assert {r.keep_id for r in rs} == {low} and {r.group_size for r in rs} == {len(ids)}
        assert [r.doc_id for r in rs if r.kept] == [low]


def test_digest_index_keeps_what_it_has_seen(spark, tmp_path):
    index = exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    make = lambda ids: spark.createDataFrame([(i, f"text {i % 10}") for i in ids], "doc_id long, text string")
    first = exact.deduplicate(make(range(15)), index, "one").collect()
    assert sum(r.kept for r in first) == 10
    again = exact.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    second = {r.doc_id: r for r in exact.deduplicate(make([3, 24, 30]), again, "two").collect()}
    assert not any(r.kept for r in second.values()) and second[24].keep_id == 4
    plan = again.unseen(again.rows().select("digest"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert again.rows().count() == 10


def test_keep_first_returns_whole_rows(docs):
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(squeeze(r.text) for r in kept.collect()) == Counter({squeeze(r.text): 1 for r in docs.collect()})


def components(sets, percent):
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    return [find(a) for a in range(len(sets))]


def test_near_duplicates(docs):
    got = minhash.near_duplicates(docs, 85).collect()
    rs = [r for r in docs.collect()]
    sets = [shingles(r.text) for r in rs]
    roots = components(sets, 85)
    low = defaultdict(list)
    for root, r, s in zip(roots, rs, sets, strict=True):
        if r.doc_id is not None:
            low[root].append(r.doc_id)
    want = Counter((r.doc_id, len(s), min(low[root], default=None)) for r, s, root in zip(rs, sets, roots, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_groups_of_many_near_copies(spark):
    """Chains and stars of variants: links between any members must join them."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    data = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{k}"
        data.append((k, " ".join(w)))
    chain = list(base)
    for k in range(150, 190):
        chain[(k * 3) % 120] = f"c{k}"
        data.append((k, " ".join(chain)))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    roots = components([shingles(t) for _, t in data], 85)
    low = {}
    for (i, _), root in zip(data, roots, strict=True):
        low[root] = min(low.get(root, i), i)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, 85).collect()} == {i: low[root] for (i, _), root in zip(data, roots, strict=True)}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    a, b = [], []
    for k in range(200):
        common = rng.integers(0, 2**63, 60 if k % 2 else 3, dtype=np.uint64)
        a.append(np.unique(np.concatenate([common, rng.integers(0, 2**63, len(common) // 3, dtype=np.uint64)])))
        b.append(np.unique(np.concatenate([common, rng.integers(0, 2**63, len(common) // 3, dtype=np.uint64)])))
    x, y = minhash.sketches(a), minhash.sketches(b)
    assert (x < np.iinfo(np.uint64).max).all()
    seen = (x == y).mean(1)
    true = np.array([len(np.intersect1d(p, q)) / len(np.union1d(p, q)) for p, q in zip(a, b, strict=True)])
    assert abs((seen - true).mean()) < 0.01 and np.abs(seen - true).max() < 0.2


def test_lines(docs):
    first, seen = {}, []
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    distinct = {(r.doc_id, r.text): r for r in docs.collect()}
    for r in sorted(distinct.values(), key=key):
        for k, line in enumerate((r.text or "").split("\n")):
            s = frozenset(shingles(line))
            if s:
                first.setdefault(s, (r.doc_id, k))
                seen.append((r.doc_id, k, s))
    sets = list(first)
    near = {s for n, s in enumerate(sets) if any(5 * len(s & t) >= 4 * len(s | t) for t in sets[:n])}
    want = defaultdict(lambda: [0, 0, 0])
    for i, k, s in seen:
        want[i][0] += 1
        want[i][1] += first[s] != (i, k)
        want[i][2] += first[s] == (i, k) and s in near
    got = linedup.deduplicate_lines(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert [r.n_lines, r.n_exact, r.n_near] == want[r.doc_id]
    assert near
    cleaned = {r.doc_id: r.text for r in linedup.cleaned(docs).collect()}
    assert len([x for x in cleaned[0].split("\n") if x]) == want[0][0] - want[0][1] - want[0][2]


def test_line_dedup_of_large_groups(spark):
    rng = random.Random(9)
    base = [f"t{k}" for k in range(60)]
    data = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"v{k}"
        data.append((k, " ".join(w)))
    sets = [shingles(t) for _, t in data]
    want = {}
    for k, s in enumerate(sets):
        same = any(s == t for t in sets[:k])
        want[k] = (same, not same and any(5 * len(s & t) >= 4 * len(s | t) for t in sets[:k]))
    got = linedup.duplicate_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.exact, r.near) for r in got} == want


def test_lines_by_distinct_words(spark):
    """One changed word in a short line: the word sets stay similar, windows of five words do not."""
    rng = random.Random(12)
    data = []
    for k in range(40):
        w = [f"w{rng.randint(0, 25)}" for _ in range(rng.randint(1, 30))]
        near = list(w)
        near[rng.randrange(len(w))] = f"x{k}"
        data += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(reversed(w)))]
    sets = [frozenset(t.split(" ")) for _, t in data]
    want = {}
    for k, s in enumerate(sets):
        same = s in sets[:k]
        want[k] = (same, not same and any(5 * len(s & t) >= 4 * len(s | t) for t in sets[:k]))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert sum(near for _, near in want.values()) > 10
    assert {r.doc_id: (r.exact, r.near) for r in linedup.duplicate_lines(frame, 80, width=1).collect()} == want
    assert "op8_line_words" in queries.queries()


def test_all_links_of_lines(spark):
    """Each line has its class and the number of links of that class, also where an earlier link is already known."""
    base = [f"w{k}" for k in range(12)]
    data = [(k, " ".join([*base[:11], f"x{k}"]) + "\nÉ " + " ".join(base[: k + 1]).upper()) for k in range(6)] + [(9, " ".join(base[::-1]) + "\n\n" + " ".join(base))]
    lines = [(d, n, frozenset(x.lower().replace("é", "É").split())) for d, t in data for n, x in enumerate(t.split("\n")) if x]
    first = {}
    for d, n, s in lines:
        first.setdefault(s, (d, n))
    links = {s: sum(s != t and 5 * len(s & t) >= 4 * len(s | t) for t in first) for s in first}
    assert max(links.values()) > 3
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.first.doc_id, r.first.line_no, r.n_links) for r in linedup.linked_lines(frame, 80, 1).collect()}
    assert got == {(d, n): (*first[s], links[s]) for d, n, s in lines}


def test_leads_of_near_copies(spark):
    """Near copies among lines that share single words with them find an earlier one by their leads: few go on to all others."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(150)]
    data = [(k, " ".join(rng.sample(words, 40))) for k in range(200)]
    base = rng.sample(words, 40)
    for k in range(100):
        w = list(base)
        w[rng.randrange(40)] = f"x{k}"
        data.append((200 + k, " ".join(w)))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    sets = linedup.classes(frame, 80, 1).withColumn("open", F.lit(True))
    found = linedup._verified(linedup._lead_pairs(sets, 80), frame, sets, 80, 1).select("a").distinct().count()
    assert 95 <= found <= 99


def test_words_of_other_alphabets(spark):
    """Only A-Z are alike in both cases, and words that differ in one character are not one token."""
    points = [c for c in (*range(0x21, 0x250), *range(0x390, 0x460), 0x1E00, 0x1E9E, 0x2126, 0x212A, 0x24B6, 0xA722, 0xFF21, 0xFF41, 0x10400, 0x10428, 0x1F600) if not 0x7F <= c < 0xA1]
    frame = spark.createDataFrame([(chr(c), f"\t{chr(c)}É  {chr(c)}É\r") for c in points], "c string, line string")
    got = {r.c: tuple(r.tokens) for r in linedup.token_sets(frame, 1).collect()}
    assert all(len(t) == 1 for t in got.values())
    alike = defaultdict(set)
    for c, t in got.items():
        alike[t].add(c)
    assert sorted("".join(sorted(x)) for x in alike.values() if len(x) > 1) == [a + a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def test_mix_reaches_targets(docs):
    got = mixing.mix(docs)
    rs = got.collect()
    assert len(rs) == docs.count()
    by = defaultdict(list)
    for r in rs:
        by[r.source].append(r)
    total = sum(r.size for r in rs)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= 3 and v[0].target <= 3 * v[0].source_size + 1e-9
        assert all(r.taken <= 3 * r.size for r in v) and sum(r.size for r in v) == v[0].source_size
    assert Counter((r.doc_id, r.size, r.taken) for r in rs) == Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(docs.repartition(7)).collect())


def test_water_levels_equal_clamping(spark):
    rng = random.Random(2)
    sizes = {f"s{k:02d}": rng.choice([0, 1, 5, 100, 3000]) * rng.randint(1, 9) for k in range(17)}
    frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    left, open_, target = float(sum(sizes.values())), set(sizes), {}
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    for r in mixing.water_levels(frame, (5, 2, 1), 3).collect():
        assert r.target == pytest.approx(target[r.source])


def test_repeat_gives_whole_rows(docs):
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.taken / r.size for r in mixing.mix(docs).collect() if r.size and r.doc_id != 0}
    times = Counter(r.doc_id for r in out.collect())
    assert all(abs(times[i] - t) <= 0.5 for i, t in taken.items())


def test_ledger(docs):
    for r, d in zip(sorted(rules.ledger(docs.where("doc_id is not null")).collect(), key=lambda r: r.doc_id), sorted(docs.where("doc_id is not null").collect(), key=lambda r: r.doc_id), strict=True):
        w = [x for x in squeeze(d.text).split(" ") if x]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (d.text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert bool(r.failed & 1) == (len(w) < 20)


def test_ablations_agree_with_single_rules(docs):
    found = rules.ledger(docs)
    bits = [r.failed for r in found.collect()]
    for row in rules.ablations(found, rules.DEFAULT).collect():
        bit = 1 << [r.name for r in rules.RULES].index(row.rule)
        assert row.failing == sum(bool(b & bit) for b in bits) and row.only_by_rule == sum(b & rules.DEFAULT.mask == bit for b in bits)
        assert row.dropped == sum(bool(b & rules.DEFAULT.mask) for b in bits)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_by_word_encoding_is_exact(tokenizer):
    rng = random.Random(4)
    alphabet = "aZé ÀßİŁ'sd're ll 0129²½̇ ñ×÷ªµ<|endoftext|> <|x \x1c\x85\xa0 日本語 😀 Σς ǅ _-#$%\t\n.,!?ﬁ\x00\x7f"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|>a don't we'll", ""]
    ours = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).encode([t.encode() for t in texts])
    for text, ids in zip(texts, ours, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(256, 4, 256), packing.Limits(256, 6, 100)])
def test_packing_covers_every_id_once(docs, tokenizer, limits):
    prompt = docs.withColumn("ask", F.when(F.col("doc_id") % 3 == 0, 5))
    got = packing.pack(prompt, public_tokenizers.path("word_bpe_49k.json"), limits, emit_ids=True, prompt_column="ask").collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        if r.doc_id not in (0, None):
            pieces[r.doc_id].append(r)
    for d in docs.collect():
        if d.doc_id in (0, None):
            continue
        ids = np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        parts = sorted(pieces[d.doc_id], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in parts) == ids
        assert all(p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) and p.doc_tokens == len(ids) // 4 for p in parts)
    ask = {r.doc_id: r.ask or 0 for r in prompt.collect()}
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        total = 0
        for p in parts:
            assert p.offset == total
            total += p.length
        assert total <= limits.tokens and len(parts) <= limits.segments
        assert sum(max(0, p.start + p.length - max(p.start, ask[p.doc_id])) for p in parts) <= limits.loss_tokens
        assert limits.loss_tokens < limits.tokens or total & (total - 1) == 0 or total == limits.tokens


def test_chat_round_trip(spark):
    rng = random.Random(6)
    pool = ["\\", "###", "#", "</turn>", "</turn", "<", ":", "\n", " ", "ü", "😀", "### Assistant: ", "a", " </turn>\n", "\\### "]
    data = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 20)))
            data.append((c, t, rng.choice(["user", "assistant", "system", "a:###</turn>\\b"]), text))
    data += [(50, 0, None, None), (50, 1, "assistant", None), (None, 0, "assistant", "x"), (51, None, "user", "first"), (51, 0, "assistant", "y"), (51, 0, "assistant", "y")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    parts = chat.format_conversations(frame)
    got = {r.conv_id: r for r in chat.read_back(parts).collect()}
    by = defaultdict(list)
    for c, t, role, text in data:
        by[c].append((t is not None, t or 0, role is not None, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2], x[3].encode(), x[4].encode()))
        said = "".join(x[4] for x in turns if x[3] == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[3]}\n{x[4]}\n" for x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    size = {}
    for r in parts.collect():
        size[r.conv_id] = size.get(r.conv_id, 0) + len(bytes(r.formatted).decode())
    assert size == {c: r.formatted_chars for c, r in got.items()}


def test_languages(docs, spark):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    known = [r for r in docs.collect() if r.lang and r.doc_id is not None and r.doc_id < 900]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in known) >= 0.95 * len(known)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 903))
    rng = random.Random(8)
    both = spark.createDataFrame([(1, words(rng, "en", 200) + " " + words(rng, "de", 100))], "doc_id long, text string")
    r = langid.predict(both, model).first()
    assert r.lang_pred == "en" and set(r.langs) == {"en", "de"} and abs(r.langs["en"] - 0.66) < 0.12
    assert langid.predict(docs, langid.fit(docs.limit(0))).first().lang_pred == "und"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {900, 901, 902, 903}


def test_word_model(docs):
    model, counts = brown.fit(docs)
    got = brown.score(docs, model, counts).collect()
    tokens = lambda t: [w for w in squeeze(t).translate({c: c + 32 for c in range(65, 91)}).split(" ") if w] + [None]
    c = Counter(w for r in docs.collect() for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        t = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), len(t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_word_model_without_training(docs, empty):
    model, counts = brown.fit(empty)
    for r in brown.score(docs, model, counts).collect():
        assert r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score


def test_transition_and_emission_sum_to_one(docs):
    model, _ = brown.fit(docs)
    assert np.allclose((10**model.step).sum(1), 1)
    sums = np.bincount(model.classes, 10**model.emit, brown.CLASSES)
    assert np.allclose(sums[np.bincount(model.classes, minlength=brown.CLASSES) > 0], 1)


def test_every_word_has_a_class_of_its_own(spark, monkeypatch):
    """Words beyond the top ones go by their contexts, not by their endings; scores do not depend on what is broadcast."""
    rng = random.Random(8)
    nouns, verbs = [f"n{k}zzz" for k in range(60)], [f"v{k}zzz" for k in range(60)]  # one ending for all
    data = [(k, " ".join(x for _ in range(12) for x in ("the", rng.choice(nouns), "will", rng.choice(verbs)))) for k in range(150)]
    data += [(900, "the n1zzz once1zzz once2zzz v1zzz unseen"), (901, "")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(brown, "TOP", 20)
    model, vocabulary = brown.fit(frame.where("doc_id < 901"))
    scores = {r.doc_id: r.score for r in brown.score(frame, model, vocabulary).collect()}
    found = Counter(r["class"] for r in vocabulary.where("class IS NOT NULL").collect())
    assert sum(found.values()) >= 100 and len(found) >= 2
    assert vocabulary.where("n < 3 AND class IS NOT NULL").count() == 0
    right, wrong = [("the n3zzz will v4zzz " * 5).strip(), ("the v4zzz will n3zzz " * 5).strip()]
    both = brown.score(spark.createDataFrame([(1, right), (2, wrong)], "doc_id long, text string"), model, vocabulary)
    both = {r.doc_id: r.score for r in both.collect()}
    assert both[1] > both[2] + 5
    monkeypatch.setattr(brown, "FREQUENT", 70)
    few, words = brown.fit(frame.where("doc_id < 901"))
    assert len(few.types.hashes) <= 70 < len(model.types.hashes)
    assert np.isclose(10**few.emit @ (few.classes >= 0), len(set(few.classes)))
    got = brown.score(frame, few, words).collect()
    assert {r["hash"]: r["class"] for r in words.collect()} == {r["hash"]: r["class"] for r in vocabulary.collect()}
    assert np.allclose(few.step, model.step)  # transitions over the join are those over the broadcast table
    assert all(abs(r.score - scores[r.doc_id]) < 0.05 * abs(scores[r.doc_id]) for r in got)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 10, 4000)
    right = (rng.integers(0, 5, 4000) * 2 + (left + 1) % 2) % 10
    of = brown.exchange(left, right, np.ones(4000), 10, classes=2)
    assert len(set(of[::2])) == 1 and len(set(of[1::2])) == 1 and of[0] != of[1]


def test_quality(docs, spark):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)] + [(3, None), (4, 1)], "doc_id long, quality int")
    marked = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.regexp_replace("text", " ", " ## ")).otherwise(F.col("text")))
    stats = quality.features(marked)
    model = quality.fit(stats, labels, F.lit(True))
    got = quality.score(stats, model, ("doc_id",)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == (r.doc_id % 2 == 0) for r in got if r.doc_id is not None and r.doc_id < 60]
    assert np.mean(right) > 0.9
    assert quality.fit(stats, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in quality.score(stats, None, ("doc_id",)).collect()} == {0.5}


def test_isotonic_is_the_nearest_monotone_sequence():
    got = quality.isotonic(np.array([0.0, 3.0, 1.0, 2.0, 5.0]), np.array([1.0, 1.0, 1.0, 2.0, 1.0]))
    assert got.tolist() == [0.0, 2.0, 2.0, 2.0, 5.0]


def test_empty_tables(empty, spark):
    assert exact.deduplicate(empty).count() == 0 and exact.keep_first(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0
    assert linedup.deduplicate_lines(empty).count() == 0 and linedup.cleaned(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.repeat(empty).count() == 0
    assert rules.ledger(empty).count() == 0 and langid.predict(empty, langid.fit(empty)).count() == 0
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    stats = quality.features(empty)
    assert quality.score(stats, quality.fit(stats, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)), ("doc_id",)).count() == 0
    model, counts = brown.fit(empty)
    assert brown.score(empty, model, counts).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0


def test_documents_in_many_languages(spark):
    """Every language of a text is found, however many there are; texts in one language stay as they are."""
    rng = random.Random(11)
    letters = {f"l{k}": "abcdefghijklmnopqrst"[4 * k : 4 * k + 4] for k in range(5)}
    text = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(n))
    train = spark.createDataFrame([(k, text(lang, 200), lang) for k in range(6) for lang in letters], "doc_id long, text string, lang string")
    mixed = [(n, " ".join(text(lang, 120) for lang in sorted(letters)[:n]), n) for n in range(1, 6)]
    got = langid.predict(spark.createDataFrame([*mixed, (9, "", 0)], "doc_id long, text string, n int"), langid.fit(train), ("doc_id", "n")).collect()
    for r in got:
        assert sorted(r.langs) == sorted(letters)[: r.n]
        assert not r.n or r.score == pytest.approx(1 / r.n, abs=0.03)


@pytest.mark.parametrize("name", ["op1_quality", "op7_langid"])
def test_held_out_accuracy(spark, name):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf).where("held_out")
    if name == "op1_quality":
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        right = got.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    else:
        truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
        right = got.join(truth, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.95


def test_quality_equals_a_dense_solution(spark):
    """Normal equations summed by partition against one matrix of all rows; calibration against scores of models without the row's fold."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    stats = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "doc_id long, stats array<float>").repartition(5)
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(stats, labels, F.lit(True))
    draws = stats.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED)), F.lit(1_000_000)) % quality.FOLDS).alias("fold")).collect()
    fold = np.array([r.fold for r in sorted(draws, key=lambda r: r.doc_id)])
    phi = model.lift(x.astype(np.float32).astype(float))
    ridge = np.eye(len(phi[0])) * quality.RIDGE
    ridge[-1, -1] = 1e-9
    weights = lambda rows: np.linalg.solve(phi[rows].T @ phi[rows] + ridge, phi[rows].T @ y[rows])
    assert np.allclose(model.raw(x.astype(np.float32).astype(float)), phi @ weights(np.arange(400)), atol=1e-6)
    outside = np.concatenate([phi[fold == f] @ weights(np.flatnonzero(fold != f)) for f in range(quality.FOLDS)])
    assert model.steps.min() >= outside.min() - 1e-6 and model.steps.max() <= outside.max() + 1e-6
    assert (np.diff(model.values) >= 0).all()


def test_language_sets_equal_plain_loops():
    """Proportions, likelihoods and the choice of the set against loops over words and sets."""
    rng = np.random.default_rng(7)
    table = np.log(rng.dirichlet(np.ones(langid.BUCKETS) * 0.05, 3).T + 1e-7)
    grams = langid.Grams(["one two three four", "uno", "", "12 ?!", "eins zwei one due tre quattro five six"])
    share, letters = langid.proportions(grams, table)
    assert letters.tolist() == [True, True, False, False, True]

    def em(like, allowed):
        p = np.array([1.0 / len(allowed) if k in allowed else 0.0 for k in range(3)])
        for _ in range(langid.ROUNDS):
            total = np.zeros(3)
            for row in like:
                total += row * p / (row * p).sum()
            p = total / len(like)
        return p, sum(np.log((row * p).sum()) for row in like)

    for text in range(5):
        words = range(grams.first_word[text], grams.first_word[text + 1])
        like = []
        for w in words:
            end = grams.word_first[w + 1] if w + 1 < len(grams.word_first) else len(grams.gram)
            logs = sum(table[g] for g in grams.gram[grams.word_first[w] : end])
            like.append(np.exp(np.maximum(logs - logs.max(), -30)))
        if not like:
            assert not letters[text]
            continue
        order = np.argsort(-em(like, range(3))[0], kind="stable")
        cost = langid.PENALTY * 0.5 * np.log(max(len(like), 2))
        fits = [em(like, list(order[:n])) for n in (1, 2, 3)]
        best = max(range(3), key=lambda n: fits[n][1] - (n + 1) * cost)
        assert np.allclose(share[text], fits[best][0], atol=1e-6)


def test_large_groups_of_near_copies_stay_linear(spark, monkeypatch):
    """A star of 3,000 copies with up to five changed words: what is compared grows with the members, not with their square."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    data = [(0, " ".join(base))]
    for k in range(1, 3000):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"x{k}y{rng.randint(0, 99)}"
        data.append((k, " ".join(w)))
    compared = []
    verify = minhash.verify
    monkeypatch.setattr(minhash, "verify", lambda pairs, *rest: compared.append(pairs.count()) or verify(pairs, *rest))
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, 85).collect()}
    assert sum(compared) < 4 * len(data)
    first = shingles(data[0][1])
    for k, text in data:
        s = shingles(text)
        both = len(s & first)
        if 100 * both >= 85 * (len(s) + len(first) - both):
            assert got[k] == 0


def test_clashing_names_in_any_case(spark):
    data = [(k, f"the river house {k % 7} stone walk " * 4, "en", f"s{k % 3}", 1.5, k, "a", 2) for k in range(30)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, Target double, ROW_KEY long, own_id string, Size__ int")
    for made in (mixing.repeat(frame), exact.keep_first(frame), minhash.keep_one(frame), langid.keep_identified(frame), linedup.cleaned(frame, 80, 1)):
        assert made.columns == frame.columns and made.count() >= 7
        assert {r.Target for r in made.collect()} == {1.5}


def test_ids_that_are_no_numbers_count_as_null(spark):
    frame = spark.createDataFrame([("a1", "the river house stone walk under"), ("7", "the river house stone walk under"), ("8", "other words")], "doc_id string, text string")
    assert sorted((r.doc_id or 0, r.keep_id) for r in exact.deduplicate(frame).collect()) == [(0, 7), (7, 7), (8, 8)]
    assert sorted((r.doc_id or 0, r.component_id) for r in minhash.near_duplicates(frame).collect()) == [(0, 7), (7, 7), (8, 8)]


def test_other_vocabularies_go_through_the_library(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    made = Tokenizer(models.WordLevel({"[u]": 0, "A": 1, "b": 2, "a": 3}, unk_token="[u]"))
    made.pre_tokenizer = pre_tokenizers.Split("-", "removed")
    made.normalizer = normalizers.Strip()
    made.save(str(tmp_path / "other.json"))
    ids = packing.WordTokenizer(str(tmp_path / "other.json")).encode([b"A-b-a", b"", b"zz-A"])
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [[1, 2, 3], [], [0, 1]]


def test_small_caches_give_the_same_ids(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"word{(k * 7 + j) % 50}x{j % 5}" for j in range(40)).encode() for k in range(30)]
    whole = list(packing.WordTokenizer(path).encode(texts))
    tight = packing.WordTokenizer(path)
    tight.words.most = tight.parts.most = 2_000
    assert [next(tight.encode([x])) for x in texts] == whole and len(tight.words.new) < 200


class Unset:
    """A session as a cluster without the setting shows it."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_shared_folder_without_the_setting():
    assert store.shared_dir(Unset("local[2]")) == store.shared_dir(Unset("local[2]")) != store.shared_dir(Unset("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_dir(Unset(master))


def test_clean_deletes_what_was_stashed(spark):
    from pathlib import Path

    kept = store.stash(spark.range(3).toDF("x"), "to-go")
    at = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert kept.count() == 3 and at.exists()
    written = dict(store._written)
    store._written.clear()
    store._written[spark.sparkContext.applicationId] = [f"file://{at}"]
    assert store.clean(spark) == 1 and not at.exists()
    store._written.update({k: [p for p in v if at.name not in p] for k, v in written.items()})


def test_unseen_words_share_what_is_discounted(docs, spark):
    model, _ = brown.fit(docs)
    assert (model.unseen < -0.2).all()  # no unseen word gets a whole group
