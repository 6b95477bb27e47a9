"""What the operators do beyond the contract rows: their methods on small inputs."""

import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from assay.llm import bpe, caps, chat, mtree, packing, partenum, pii, quality, repair, secrets, sharding, toxicity, whitening
from assay.llm.common import at_rest, prepare


def documents(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def filler(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_words_that_reveal_an_entity_are_taken_out(spark):
    prepare(spark)
    rng = random.Random(1)
    texts = [f"{filler(rng, 20)} please ask Zebulon at z.k@mail.example or call {filler(rng, 20)}" for _ in range(6)]
    texts += [f"{filler(rng, 20)} please ask anyone or call {filler(rng, 20)}" for _ in range(60)]
    copies = [f"{filler(rng, 9)} Onlycopied wrote to c.c@mail.example today"] * 8
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(spark, texts + copies)).collect()}
    assert all("Zebulon" not in clean[i] and "[EMAIL]" in clean[i] and "please ask" in clean[i] for i in range(6))
    assert all(clean[i] == texts[i] for i in range(6, 66))
    assert all("Onlycopied" in clean[i] and "c.c@" not in clean[i] for i in range(66, 74))  # one context is no evidence


def test_copies_do_not_hide_a_disclosing_word(spark):
    prepare(spark)
    rng = random.Random(15)
    texts = [f"{filler(rng, 20)} ask Zebulon at z.k@mail.example or call {filler(rng, 20)}" for _ in range(4)]
    texts += [texts[0]] * 60 + [f"{filler(rng, 20)} ask anyone or call {filler(rng, 20)}" for _ in range(60)]
    clean = [r["text"] for r in pii.sanitise(documents(spark, texts)).collect()]
    assert not any("Zebulon" in t for t in clean) and all(" or call " in t for t in clean)


def test_disclosing_words_go_at_any_distance(spark):
    prepare(spark)
    rng = random.Random(16)
    texts = [f"{filler(rng, 20)} z.k@mail.example {filler(rng, 60)} Zebulon {filler(rng, 60)} zebulon {filler(rng, 2)}" for _ in range(5)]
    texts += [f"{filler(rng, 20)} w.w@mail.example {filler(rng, 60)} Wanda" for _ in range(2)]
    near = filler(rng, 30)
    texts += [f"{near} n.n@mail.example {near} Nearcopied {i}" for i in range(10)]
    texts += [filler(rng, 40) for _ in range(60)]
    clean = [r["text"] for r in pii.sanitise(documents(spark, texts)).orderBy("doc_id").collect()]
    assert not any("zebulon" in t.lower() for t in clean[:5]) and all("[EMAIL]" in t for t in clean[:17])
    assert all("Wanda" in t for t in clean[5:7]) and all("Nearcopied" in t for t in clean[7:17])  # too few contexts
    assert clean[17:] == texts[17:]


def test_only_repeated_texts_are_shuffled_to_count_words(spark):
    prepare(spark)
    texts = ["alpha beta beta", "alpha gamma", "alpha gamma", "alpha gamma", "", "none", "none", "Beta delta", "delta Delta"]
    docs = documents(spark, texts).withColumn("text", F.when(F.col("text") != "none", F.col("text")))
    counts = pii.document_counts(docs, "text")
    assert {r["term"]: r["n_t"] for r in counts.collect()} == {"alpha": 2, "beta": 2, "gamma": 1, "delta": 2}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan.split("first(terms")[1]  # before: the terms of every text


def test_words_in_signs_are_counted_like_others(spark):
    prepare(spark)
    rng = random.Random(17)
    texts = [f"{filler(rng, 20)} Contact:z.k@mail.example key=value it's' {filler(rng, 20)}" for _ in range(4)]
    texts += [f"{filler(rng, 20)} Contact:nobody key=value it's' {filler(rng, 20)}" for _ in range(60)]
    clean = [r["text"] for r in pii.sanitise(documents(spark, texts)).collect()]
    assert all("Contact:" in t and "key=value it's'" in t for t in clean)


def test_weak_parts_need_complements(spark):
    prepare(spark)
    token = "Ab3dEf6hIj9lMn2pQr"
    texts = [f"user=anna01 {token}", f"{token} and nothing else", f"user=anna01 {'x ' * 200}{token}",
             f"https://h.example/p user: bob777 password=abcdef12", "https://h.example/p user: bob777", "user: bob777"]
    found = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(documents(spark, texts)).collect()}
    kinds = {d: sorted(x.split(":")[0] for x in s.split(",") if x) for d, s in found.items()}
    assert kinds == {0: ["identifier", "token"], 1: [], 2: [], 3: ["assign", "endpoint", "identifier"], 4: [], 5: []}


def test_long_parts_are_linked_in_either_order(spark):
    prepare(spark)
    texts = [t for n in (150, 170, 330, 400, 2000) for t in (f"secret={'k' * n} user=bob123", f"user=bob123 secret={'k' * n}")]
    texts += [f"secret={'k' * 400} {'. ' * 100}user=bob123", f"user=bob123 {'. ' * 100}secret={'k' * 400}"]
    found = {r["doc_id"]: "identifier" in r["spans"] for r in secrets.secret_spans(documents(spark, texts)).collect()}
    assert found == {i: i < 10 for i in range(12)}


def test_frequent_lines_go_and_depleted_documents_fail(spark):
    prepare(spark)
    rng = random.Random(2)
    banner = "accept all cookies of this site and of our many partners now"
    mostly = [f"{filler(rng, 30)}\n{banner.upper()}\n{filler(rng, 5)}" for _ in range(40)]
    only = [f"{banner}\n{filler(rng, 2)}" for _ in range(3)]
    near = filler(rng, 60)
    copies = [f"{near}\n{near[::-1]}\nnumber {i}" for i in range(30)]
    docs = documents(spark, mostly + only + copies)
    rows = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert all(rows[i]["kept"] and rows[i]["removed_lines"] == 1 for i in range(40))
    assert not any(rows[i]["kept"] for i in range(40, 43))
    assert all(rows[i]["kept"] and rows[i]["removed_lines"] == 0 for i in range(43, 73))  # copies are one document
    kept = {r["doc_id"]: r["text"] for r in quality.kept_documents(docs).collect()}
    assert set(kept) == {*range(40), *range(43, 73)} and not any("COOKIES" in t for t in kept.values())
    other = documents(spark, mostly[:5], "t")
    assert all(r["removed_lines"] == 0 for r in quality.judged(other).collect())


def test_a_line_that_makes_up_most_of_its_documents_is_counted_in_each(spark):
    prepare(spark)
    rng = random.Random(12)
    banner, footer = filler(rng, 60), filler(rng, 40)
    depleted = [f"{banner}\n{filler(rng, 20)}" for _ in range(45)]
    short = [f"{footer}\nitem {i}" for i in range(45)]
    plain = [filler(rng, 30) for _ in range(510)]
    rows = quality.measured(documents(spark, depleted + short + plain), "doc_id", "text", "source")
    assert sorted(r["line_docs"] for r in quality.frequent_lines(rows).collect()) == [45, 45]
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(documents(spark, depleted + short + plain)).collect()}
    assert not any(kept[i] for i in range(90)) and all(kept[i] for i in range(90, 600))


def test_two_lines_in_the_same_documents_do_not_hide_each_other(spark):
    prepare(spark)
    rng = random.Random(13)
    head, foot = filler(rng, 60), filler(rng, 60)
    both = [f"{head}\n{filler(rng, 20)}\n{foot}" for _ in range(60)]
    rows = quality.measured(documents(spark, both + [filler(rng, 30) for _ in range(540)]), "doc_id", "text", "source")
    counts = [r["line_docs"] for r in quality.frequent_lines(rows).collect()]
    assert counts == [60, 60]


def test_shares_and_limits_count_distinct_documents(spark):
    prepare(spark)
    rng = random.Random(14)
    line, copied = filler(rng, 12), filler(rng, 50)
    holding = [f"{filler(rng, 30)}\n{line}" for _ in range(40)]
    among_copies = quality.measured(documents(spark, holding + [copied] * 1000), "doc_id", "text", "source")
    assert [r["line_docs"] for r in quality.frequent_lines(among_copies).collect()] == [40]
    large = quality.measured(documents(spark, holding + [filler(rng, 12) for _ in range(1000)]), "doc_id", "text", "source")
    assert quality.frequent_lines(large).count() == 0
    assert [r["line_docs"] for r in quality.frequent_lines(large, many_docs=40).collect()] == [40]


@pytest.mark.parametrize("weights", [[1.0] * 5, [1.0, 1.0, 4.0]])
def test_rendezvous_follows_weights_and_moves_little(spark, weights):
    keys = spark.range(20_000)
    one = sharding.rendezvous(F.col("id"), weights).alias("a")
    two = sharding.rendezvous(F.col("id"), [*weights, 1.0]).alias("b")
    rows = keys.select(one, two).collect()
    counts = Counter(r["a"] for r in rows)
    for shard, weight in enumerate(weights):
        assert abs(counts[shard] / 20_000 - weight / sum(weights)) < 0.02
    assert {r["b"] for r in rows if r["a"] != r["b"]} == {len(weights)}
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [1.0, 0.0])


def test_layouts_become_turns(spark):
    prepare(spark)
    records = [
        {"prompt": "p", "completion": "c"}, {"instruction": "i", "input": "n", "output": "o"}, {"instruction": "i", "output": "o"},
        {"messages": [{"role": "system", "content": "s"}, {"role": "gpt", "content": None}]},
        {"id": 9, "conversations": [{"from": "human", "value": "h <|end|>"}, {"from": "gpt", "value": "g\\"}]},
        {"question": "q", "answer": "a"}, {"system": "s", "prompt": "p", "response": "r"}, {"odd": 1}, [], None]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(99, "{broken"), (98, None)], "n int, record string")
    rows = chat.formatted_turns(df.coalesce(1)).collect()
    turns = [(r["layout"], *chat.parsed(r["block"])) for r in rows if r["block"]]
    assert turns == [
        ("prompt and completion", "user", "p"), ("prompt and completion", "assistant", "c"),
        ("instruction with input", "user", "i\n\nn"), ("instruction with input", "assistant", "o"),
        ("instruction", "user", "i"), ("instruction", "assistant", "o"), ("messages", "system", "s"), ("messages", "assistant", ""),
        ("keyed speaker list", "user", "h <|end|>"), ("keyed speaker list", "assistant", "g\\"),
        ("question and answer", "user", "q"), ("question and answer", "assistant", "a"),
        ("system, prompt and response", "system", "s"), ("system, prompt and response", "user", "p"),
        ("system, prompt and response", "assistant", "r")]
    assert sum(r["layout"] == "unknown" for r in rows) == 5
    assert all(r["block"].count(chat.TURN_CLOSE) == 1 for r in rows if r["block"])


@pytest.mark.parametrize("text", ["", "\\", "\\\\<s>", "<\\|turn|>", "<|turn|><|end|></s>[/INST]", "[INST]\n\\[INST]"])
def test_escapes_are_undone(text):
    assert chat.unescaped(chat.escaped(text)) == text and not chat.CONTROL_RE.search(chat.escaped(text))


def test_packer_fills_windows_from_shorter_tiers():
    rng = random.Random(4)
    packer, windows, sizes = packing.TierPacker((8, 16, 32, 64)), [], [rng.randrange(1, 150) for _ in range(300)] + [64, 8, 1]
    for i, n in enumerate(sizes):
        windows += packer.add(i, n)
        if i % 50 == 0:
            windows += packer.fill()
    windows += [*packer.fill(), *packer.finish()]
    seen = Counter()
    for w in windows:
        total = sum(p[0] for p in w)
        assert total & (total - 1) == 0 and total <= 64
        for length, doc, start in w:
            seen.update((doc, start + k) for k in range(length))
    assert seen == Counter((i, k) for i, n in enumerate(sizes) for k in range(n))
    assert sum(sum(p[0] for p in w) < 8 for w in windows) <= 3  # only the last rest is cut small
    with pytest.raises(ValueError):
        packing.TierPacker((12,))


def test_transducer_emits_early_and_holds_little():
    table = bpe.codec(bpe.default_path()).table
    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    rng = random.Random(5)
    for letters in ("ab", "etaoin", "z", "thisinger"):
        text = "".join(rng.choice(letters) for _ in range(40_000))
        stream, ids, most = bpe.Transducer(table), [], 0
        for at in range(0, len(text), 977):
            ids += stream.feed(text[at:at + 977].encode())
            most = max(most, len(stream.window))
        assert most <= 2 * stream.step and len(ids) > 0  # nothing is held back beyond the window
        ids += stream.flush()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_lookahead_of_a_small_merge_list():
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    # whether a+b happens depends on b+c, which depends on c+d
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3


def test_new_pieces_are_merged_together_as_one_by_one(monkeypatch):
    tool = bpe.Codec(bpe.default_path())
    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    rng = random.Random(22)
    letters = "etaoinshrdlu.,'é漢\U0001f6000123-\n\x1c\u00a0"
    pieces = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(500)})
    assert tool.table.merge_all(pieces) == [tool.pack(tool.table.merge(p.encode())) for p in pieces]
    assert tool.table.merge_all([]) == []
    texts = [" ".join(rng.choice(pieces) for _ in range(40)) for _ in range(30)]
    texts += ["", "a", " ", "a  b", "<|endoftext|> x<|endoftext|>", "x" * 200, "it's 'tis don't"]
    tool.learn(texts)
    assert [tool.encode(t).tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    words = [" ".join(["q"] + ["".join(rng.choice("etaoins") for _ in range(12)) for _ in range(50)]) for _ in range(5)]
    tool.learn(words)
    expected = [library.encode(t, add_special_tokens=False).ids for t in words]
    monkeypatch.setattr(tool.table, "merge", lambda data: pytest.fail("a piece was merged alone") if len(data) > 1 else [tool.table.byte_id[data[0]]])
    assert [tool.encode(t).tolist() for t in words] == expected
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 10)  # a table that is full begins anew
    monkeypatch.setattr(bpe, "MEMO_PRETOKENS", 3)
    small = bpe.Codec(bpe.default_path())
    for at in range(0, len(texts), 5):
        small.learn(texts[at:at + 5])
        assert [small.encode(t).tolist() for t in texts[at:at + 5]] == [
            library.encode(t, add_special_tokens=False).ids for t in texts[at:at + 5]]


def test_decoder_carries_open_characters():
    tool = bpe.codec(bpe.default_path())
    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    rng = random.Random(6)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(40)]
        assert tool.decode(np.array(ids, "i4")) == library.decode(ids, skip_special_tokens=False)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(7)
    signer = partenum.Signer(np.zeros(0, np.uint64), np.zeros(0, np.int64), 75)
    for size in [1, 2, 3, 4, 5, 7, 8, 15, 16, 31, 33, 63, 64, 100, 127, 128, 200, 255, 257, 400, 1000]:
        for _ in range(12):
            a = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
            for gone, new in ((0, 0), (len(a) // 4, 0), (0, len(a) // 3), (len(a) // 8, len(a) // 10), (len(a) // 7, len(a) // 7)):
                b = np.unique(np.concatenate([rng.permutation(a)[:len(a) - gone], rng.integers(1, 1 << 62, new).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
                    assert set(signer.sign(a)) & set(signer.sign(b)), (size, gone, new)


def test_parity_is_a_lower_bound_that_tells_sets_apart():
    rng = np.random.default_rng(11)
    for size in (1, 5, 500, 511, 512, 600, 3000):
        a = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
        for gone in (0, 1, size // 8, size // 2, size):
            b = np.unique(np.concatenate([rng.permutation(a)[:len(a) - gone], rng.integers(1, 1 << 62, gone + size // 4).astype(np.uint64)]))
            apart = len(np.setxor1d(a, b))
            assert partenum.apart_at_least(partenum.parity(a), partenum.parity(b)) <= apart, (size, gone)
    a, b = (np.unique(rng.integers(1, 1 << 62, 3000).astype(np.uint64)) for _ in range(2))
    assert partenum.apart_at_least(partenum.parity(a), partenum.parity(b)) > partenum.most_apart(3000, 3000, 75)


def test_buckets_of_the_same_members_count_once_and_shared_names_differ(spark):
    prepare(spark)
    rows = [([10, 11, 12, 13], 1), ([10, 11, 12], 2), ([13, 14], 3), ([10, 11, 12, 13], 1), (None, 4)]
    nodes = spark.createDataFrame(rows, "sigs array<bigint>, node long")
    found = {(r["sig"], r["node"]) for r in partenum.shared_signatures(nodes).collect()}
    assert found == {(10, 1), (10, 2), (13, 1), (13, 3)}
    sets = partenum.distinct_sets(spark.createDataFrame(
        [(b"a", 7, b"x", 3, [0], b"p"), (b"b", 7, b"y", 4, None, None), (b"b", 7, b"w", 4, [1], b"q"), (b"c", 8, b"z", 0, [0], b"r")],
        "set_key binary, node long, text_key binary, size long, sketch array<bigint>, parity binary"))
    names = {bytes(r["set_key"]): (r["node"], r["name"], bytes(r["text_key"]), bytes(r["parity"])) for r in sets.collect()}
    assert names[b"a"] == (7, 7, b"x", b"p") and names[b"b"][0] == 7 != names[b"b"][1] and names[b"b"][2:] == (b"w", b"q") and len(names) == 2
    assert [bytes(r["set_key"]) for r in partenum.renamed(sets).collect()] == [b"b"]


def test_buckets_of_nearly_the_same_members_become_one_and_lose_no_pair(spark):
    prepare(spark)
    rng = random.Random(21)
    rows = [(s, n) for s in range(100) for n in rng.sample(range(30), 27)]  # large sets of one family
    rows += [(1000 + s, n) for s in range(40) for n in (50 + s % 10, 100 * s + 100, 100 * s + 101)]
    buckets = spark.createDataFrame([(s, n, n, 100, [0] * 8) for s, n in rows], "sig long, node long, root long, size long, sketch array<bigint>")

    def pairs(found):
        held = {}
        for s, n in found:
            held.setdefault(s, set()).add(n)
        return [(a, b) for own in held.values() for a in own for b in own if a < b]

    merged = pairs((r["sig"], r["node"]) for r in partenum.merged_buckets(buckets).collect())
    assert set(pairs(rows)) <= set(merged)
    assert len(merged) < len(pairs(rows)) / 10  # 100 buckets of 351 pairs were compared one by one
    assert {(r["a"], r["b"]) for r in partenum.all_pairs(buckets, 75).collect()} == set(merged)
    one = [(s, n) for s in range(40) for n in (7, 1000 + s)]  # unlike buckets that share a node: a union has more pairs
    apart = spark.createDataFrame(one, "sig long, node long")
    assert len(pairs((r["sig"], r["node"]) for r in partenum.merged_buckets(apart).collect())) == 40


def test_components_of_chains_and_stars(spark):
    prepare(spark)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 40)]
    links = spark.createDataFrame(chain + star + [(5000, 4000), (4000, 5000)], "a long, b long")
    found = {r["node"]: r["root"] for r in partenum.components(links).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and all(found[1000 + i] == 1000 for i in range(1, 40)) and found[5000] == 4000


def test_toxicity_sample_is_bounded_where_ids_repeat(spark):
    prepare(spark)
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(700)] + [(8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] * 3, "doc_id long, toxic long")
    rows = toxicity.labelled_sample(docs, labels, 5).collect()
    assert 0 < len(rows) <= 5 and {r["text"] for r in rows} <= {*(min(f"text {i}" for i in range(k, 700, 7)) for k in range(7)), None}


def test_folding_and_exceptions():
    model = toxicity.Model({" idiot ": 2.0, " mor": 3.0}, (" village idiot ",), (-1.0, 2.0, 0.0))
    automaton = model.automaton()
    hits = lambda t: model.strength(t, automaton)[2]
    assert [hits(t) for t in ("1d10t!", "the іDІOT", "idiotic", "Moron, MORTAL", "village idiot", "an idiot of a village idiot", "", None)] \
        == [1, 1, 0, 2, 0, 1, 0, 0]
    assert model.score(*model.strength("moron", automaton)[:2]) > 0.5 > model.score(*model.strength("fine", automaton)[:2])


def test_toxicity_learns_words_and_beginnings(spark):
    prepare(spark)
    rng = random.Random(8)
    texts, marks = [], []
    for i in range(600):
        toxic = i % 4 == 0
        extra = rng.choice(["grumblefoo", "snarl" + filler(rng, 1)]) if toxic else "calm"
        texts.append(f"{filler(rng, 30)} {extra} {filler(rng, 30)}")
        marks.append((i, 1, int(toxic)))
    docs = documents(spark, texts)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity_rows(docs, labels).collect()}
    held = [(r["predicted"], i % 4 == 0) for i, r in rows.items() if r["held_out"]]
    assert len(held) > 60 and sum(p == t for p, t in held) / len(held) > 0.97
    none = toxicity.learn(docs, labels.filter("toxic = 0"))
    assert not none.weights and none.score(0.0, 0.0) < 0.5


def test_tree_bounds_save_work_and_lose_nothing():
    rng = np.random.default_rng(9)
    centers = rng.integers(-400, 400, (12, 16))
    vectors = centers[rng.integers(0, 12, 1500)] + rng.integers(-6, 7, (1500, 16))
    ids = np.arange(1500)
    queries = mtree.Queries(ids[:40], ids[:40], vectors[:40], np.full(40, mtree.NEVER), 10)
    computed = []
    plain = mtree.products
    mtree.products = lambda a, b: computed.append(len(a) * len(b)) or plain(a, b)
    try:
        queries.search(mtree.bulk_load(ids, ids, vectors))
    finally:
        mtree.products = plain
    found = {}
    for row, _, other, score in queries.results():
        found.setdefault(row, []).append((-score, other))
    scores = vectors @ vectors[:40].T
    for q in range(40):
        order = sorted((-int(scores[j, q]), j) for j in range(1500) if j != q)[:10]
        assert sorted(found[q]) == order
    assert sum(computed) < 0.6 * 40 * 1500


def table_of_vectors(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)


def test_rows_that_the_search_reads_stay_small(spark, monkeypatch):
    prepare(spark)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(4000, 64))
    vectors[:1500] = vectors[0]
    df, read = table_of_vectors(spark, vectors / 8), []
    kind, plain = type(df), type(df).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: read.append(self) or plain(self, *a, **b))
    mtree.top_k(df, lambda i: i % 20 == 0)
    searched = read[-1]
    size = sum(F.octet_length(c) for c, t in searched.dtypes if t == "binary")
    assert searched.agg(F.max(size)).first()[0] < 100_000


@pytest.mark.parametrize("size", [0.5, 1e4, 1e6])  # computed in 32 and 64 bits of floating point and as integers
def test_tiles_of_queries_and_parts_of_trees_find_the_same(spark, monkeypatch, size):
    prepare(spark)
    rng = np.random.default_rng(5)
    centers = rng.uniform(-size, size, (6, 8))
    vectors = (centers[rng.integers(0, 6, 1200)] + rng.uniform(-size, size, (1200, 8)) / 4).astype(np.float32)
    vectors[::3] = vectors[0]
    for name, value in {"TREE_BYTES": 8_000, "TILE_BYTES": 16_000, "QUERY_BLOCK": 16, "SAMPLE": 50}.items():
        monkeypatch.setattr(mtree, name, value)
    whole = np.floor(vectors.astype(float) * mtree.SCALE).astype(np.int64)
    shape = mtree.Shape(8, int(whole.min()), int(whole.max()))
    assert shape.computed == {0.5: np.float32, 1e4: np.float64, 1e6: np.int64}[size]
    found = mtree.top_k(table_of_vectors(spark, vectors), lambda i: i % 5 == 0, k=7)
    expected = []
    for q in range(0, 1200, 5):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:7]
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, found.collect())) == expected


def test_equal_vectors_fill_pages_of_rising_ids():
    ids = np.random.default_rng(6).permutation(2000)
    for vectors in (np.full((2000, 4), 3), np.full((2000, 4), (1 << 62) + 1)):
        pages = mtree.bulk_load(ids, ids, vectors)["pages"]
        assert max(len(p["ids"]) for p in pages) <= mtree.LEAF
        assert all(a["ids"].max() < b["least"] for a, b in zip(pages, pages[1:]))


@pytest.mark.parametrize("chunk_bits", [0, 2, 12])
def test_chunks_of_any_size_give_the_same_repair(spark, chunk_bits):
    prepare(spark)
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(30)]:
        roles = rng.choice([["user"], ["user", "assistant"], ["assistant", "system"], ["user", "assistant", "system", "tool", None, ""]])
        for i in range(rng.randrange(1, 40)):
            text = rng.choice(["a.", "b", "hi!", "", " ", None, f"x {rng.random()}", f"y {rng.random()}.", f"z {rng.random()}? \n"])
            rows.append((conv, rng.choice([None, i, i, i, i // 2, 2 * i]), rng.choice(roles), text))
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = Counter(tuple(r) for r in repair.repaired_conversations(talk, chunk_bits).collect())
    assert found == Counter(brute.repaired(rows))


def test_guesses_span_every_true_cost_vector():
    rng = random.Random(6)
    for _ in range(200):
        costs = repair.END
        for _ in range(rng.randrange(30)):
            costs = repair.before(rng.randrange(4) + (rng.randrange(4) << repair.FAULT_SHIFT), costs)
        assert all(costs[q] <= costs[t] + most for (q, t), most in repair.BOUNDS.items())
        spanned = tuple(min(costs[t] + g[q] for t, g in enumerate(repair.generators())) for q in range(repair.STATES))
        assert spanned == costs


def test_cross_products_are_exact_beyond_64_bits():
    rng = random.Random(7)
    for high in (1, 200, 2 ** 40, 2 ** 63 - 1):
        x = np.array([[rng.randint(-high - 1, high) for _ in range(5)] for _ in range(130)], np.int64)
        ones = [[*map(int, row), 1] for row in x]
        expected = [[sum(r[i] * r[j] for r in ones) for j in range(6)] for i in range(6)]
        assert whitening.cross_products(x).tolist() == expected
        assert all(sum(d << (whitening.LIMB_BITS * k) for k, d in enumerate(whitening.limbs(v))) == v for row in expected for v in row)


def test_whitening_of_large_entries_and_constant_dimensions(spark):
    prepare(spark)
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1e15, 1e15, 3.0]), 2.0, float(i)]) for i in range(50)] + [(50, [1e300, 2.0, 0.0])]
    found = whitening.whitening_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["n"] for r in found} == {51} and {r["vec_id"] for r in found} == set(range(51))
    assert all(r["deviation"] is None for r in found) and all(r["identity_error"] < 1e-4 for r in found)
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whitening_rows(one).count() == 0


def test_caps_find_all_links_and_blocks_none_twice(spark, monkeypatch):
    prepare(spark)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((4, 24))
    vectors = np.concatenate([c / np.linalg.norm(c) + 0.07 * rng.standard_normal((60, 24)) for c in centres] + [rng.standard_normal((200, 24))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*vectors, *[vectors[0]] * 90, *vectors[:20] * 3.0])]
    monkeypatch.setattr(caps.cells, "__defaults__", (16,))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.near_duplicate_rows(table).collect()}
    counts, first = brute.cosine_links([v for _, v in rows])
    recall = sum(n for n, _ in found.values()) / sum(counts)
    assert 0.99 < recall <= 1 and all(found[i][0] <= n for i, n in enumerate(counts))
    assert [found[i][1] for i in range(len(rows))] == first


def test_thousands_of_lines_in_one_document(spark):
    prepare(spark)
    rng = random.Random(10)
    text = "\n".join(filler(rng, 5) if i % 4 else "the same line stands here" for i in range(8000))
    row = quality.quality_rows(documents(spark, [text])).first()
    base = brute.quality_base(text)
    assert tuple(row[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
    assert not row["kept"] and row["base_failed"]


def test_records_that_cannot_be_read_are_of_unknown_layout(spark):
    prepare(spark)
    good = json.dumps({"conv_id": 1, "turn": 0, "role": "user", "text": "hello"})
    records = [good, "[" * 100_000, '{"a":' * 50_000, good.replace('"turn": 0', '"turn": "first"'), good.replace('"turn": 0', f'"turn": {2 ** 70}'), "{", None, ""]
    rows = chat.formatted_turns(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert [r["layout"] == "unknown" for r in rows] == [False] + [True] * 7
    assert chat.read_back(chat.formatted_turns(spark.createDataFrame([(r,) for r in records], "record string"))).count() == 1


def test_groups_of_texts_are_encoded_as_by_the_library_and_remembered_within_bounds(monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    rng = random.Random(5)
    letters = "etaoin sh  rdlu.,'é漢\U0001f6000123-\n\x1c \t\"_("
    for entries, group, block in [(10, 300, 200), (1 << 18, 1 << 21, 1 << 16), (50, 40, 1 << 16)]:
        monkeypatch.setattr(bpe, "MEMO_ENTRIES", entries)
        monkeypatch.setattr(bpe, "GROUP_CHARS", group)
        monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
        tool = bpe.Codec(bpe.default_path())
        for _ in range(10):
            texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice([4, 30, 400])))) for _ in range(40)]
            texts += ["", None, " ", "a ", "abc ", " a", "a  b", "x<|endoftext|>y a", "word. word, 'tis don't's it's.", "w" * 100 + " a.",
                      " ".join(["dog's"] * 30), "a'. b's, c'll; d . e."]
            rng.shuffle(texts)
            assert [np.frombuffer(x, "<i4").tolist() for x in tool.encode_all(texts)] == [
                library.encode(t or "", add_special_tokens=False).ids for t in texts]
            most = max(len((t or "").split(" ")) for t in texts) * len(texts)
            assert max(len(tool.memo), len(tool.memo.older)) <= 2 * entries + most
    assert list(tool.encode_all([])) == [] and list(tool.encode_all([None])) == [b""]


def test_pieces_used_again_outlive_a_full_table(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 40)
    tool = bpe.Codec(bpe.default_path())
    rng, merged = random.Random(9), []
    merge_all = tool.table.merge_all
    monkeypatch.setattr(tool.table, "merge_all", lambda pieces: merged.extend(pieces) or merge_all(pieces))
    for _ in range(20):
        list(tool.encode_all(["x often " + " ".join("".join(rng.choice("etaoins") for _ in range(12)) for _ in range(30))]))
        assert len(tool.memo) + len(tool.memo.older) < 200
    assert merged.count(" often") == 1


def test_texts_are_encoded_and_packed_in_one_pass(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["tion", "the.", "a,", "é漢", "x\ny"]) for _ in range(rng.randrange(900)))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, None), (7, ""), (7, "")], "doc_id long, text string").coalesce(1)
    whole = packing.encode_and_pack(docs)
    assert sorted(map(str, whole.collect())) == sorted(map(str, packing.pack(bpe.encode_documents(docs)).collect()))
    # encoded and packed by one Python worker a task
    assert whole._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert packing.packed_documents(docs).count() == whole.count()


def test_unused_memory_goes_back_behind_a_tasks_batches():
    import pyarrow as pa

    def batches():
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])

    released = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("assay.llm.common.pa.default_memory_pool", lambda: type("P", (), {"release_unused": lambda self: released.append(1)})())
        got = at_rest(batches())
        assert next(got).num_rows == 1 and not released
        assert list(got) == [] and released == [1]
