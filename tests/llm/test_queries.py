"""Every contract query against plain versions, on driver rows and edge rows; empty tables; clashing names."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from assay.llm.queries import QUERIES

hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
BY_NUMBER = {int(n[2:].split("_")[0]): f for n, f in QUERIES.items()}


@pytest.fixture(scope="module")
def results(spark, edge_dir):
    held = {}

    def of(n: int):
        if n not in held:
            held[n] = [r.asDict() for r in BY_NUMBER[n](spark, edge_dir).collect()]
        return held[n]

    return of


def same_bag(found, expected):
    assert Counter(found) == Counter(expected)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_personal_data(results, edge_docs):
    expected = []
    for doc, text in edge_docs:
        base = brute.pii_base(text)
        written = ",".join(f"{k}:{s}:{e}" for k, v in base.items() for s, e in v)
        expected.append((doc, *(len(v) for v in base.values()), hexed(written)))
    rows = results(1)
    same_bag([(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows], expected)
    assert sum(r["n_email"] + r["n_card"] for r in rows) > 4


def test_secrets(results, edge_docs):
    expected, texts = [], dict(edge_docs)
    for doc, text in edge_docs:
        base = brute.secret_base(text)
        kinds = Counter(k for _, _, k, _ in base)
        expected.append((doc, kinds["assign"], kinds["access"], kinds["hex"], hexed(",".join(f"{k}:{s}:{e}" for s, _, k, e in base))))
    rows = results(10)
    same_bag([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows], expected)
    weak = {texts[r["doc_id"]][int(s):int(e)] for r in rows for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)
            if k in ("token", "identifier", "endpoint")}
    assert {"Zk3xQ9vLw2Rt8YbN4mPq", "user: admin7", "https://db.example.org/x"} <= weak
    assert all("token" not in r["spans"] for r in rows if r["doc_id"] and "alone far" in texts[r["doc_id"]])


def test_quality(results, edge_docs):
    expected = [(doc, *(q := brute.quality_base(text)), q[0] < 10 or 100 * q[4] > 20 * q[0]) for doc, text in edge_docs]
    rows = results(7)
    same_bag([tuple(r[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
              for r in rows], expected)
    assert not any(r["kept"] and r["base_failed"] for r in rows) and any(r["kept"] for r in rows)


def test_sharding(results, edge_docs):
    rows = results(2)
    same_bag([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows],
             [(d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in edge_docs])
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        homes[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_chat(spark, edge_dir, results):
    talk = defaultdict(list)
    for r in spark.read.parquet(f"{edge_dir}/conversations.parquet").collect():
        talk[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    talk[-7] = [(0, "user", said), (1, "assistant", said)]
    rows = {r["conv_id"]: r for r in results(3)}
    assert rows.keys() == talk.keys()
    for conv, turns in talk.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2]) if conv != 900_000 else (t[0], t[1], t[2] != "b"))
        options = [turns, sorted(turns, key=lambda t: (t[0], t[1], t[2]))]
        digests = [hexed("".join(f"{r}\n{t}\n" for _, r, t in o)) for o in options]
        trained = ["".join(t for _, r, t in o if r == "assistant") for o in options]
        row = rows[conv]
        assert row["n_turns"] == len(turns) and row["turns_sha256"] in digests
        assert row["loss_chars"] == len(trained[0]) and row["loss_sha256"] in map(hexed, trained)
        assert row["formatted_chars"] > sum(len(t) for _, _, t in turns)


def test_bpe(results, edge_docs, tokenizer):
    expected = []
    for doc, text in edge_docs:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        expected.append((doc, len(ids), hexed(",".join(map(str, ids))), hexed(tokenizer.decode(ids, skip_special_tokens=False))))
    same_bag([(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in results(5)], expected)


def test_packing(results, edge_docs, tokenizer):
    rows = results(4)
    ids = {}
    for doc, text in edge_docs:
        if doc is not None and doc != 900_010:  # ids of one row each
            ids[doc] = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, own in ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0 and at == pieces[0]["tier"]
        assert len({r["step"] for r in pieces}) == 1


def test_join(results, edge_docs):
    docs = sorted(((d, t) for d, t in edge_docs), key=lambda x: (x[0] is None, x[0] or 0))
    sets = [brute.shingle_set(t) for _, t in docs]
    roots = brute.link_classes(sets)
    expected = [(d, len(s), docs[r][0]) for (d, _), s, r in zip(docs, sets, roots)]
    same_bag([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in results(6)], expected)


def test_toxicity(spark, edge_dir, results, edge_docs):
    rows = results(8)
    same_bag([(r["doc_id"], r["held_out"]) for r in rows],
             [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0) for d, _ in edge_docs])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    toxic = [by_id[r["doc_id"]] for r in spark.read.parquet(f"{edge_dir}/labels.parquet").filter("toxic = 1").collect() if r["doc_id"]]
    clean = [by_id[r["doc_id"]] for r in spark.read.parquet(f"{edge_dir}/labels.parquet").filter("toxic = 0").collect() if r["doc_id"]]
    assert np.mean(toxic) > np.mean(clean)


def test_search(spark, edge_dir, results):
    kept = []
    for r in spark.read.parquet(f"{edge_dir}/embeddings.parquet").collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((r["vec_id"], np.pad(np.floor(64 * np.array(v, float)), (0, 64 - len(v))).astype(int)))
    ids, matrix = np.array([i for i, _ in kept]), np.array([v for _, v in kept])
    expected = []
    for n, (q, v) in enumerate(kept):
        if q % 20 == 0:
            scores = matrix @ v
            best = [j for j in np.lexsort((ids, -scores)) if j != n][:20]
            expected += [(q, rank + 1, int(ids[j]), int(scores[j])) for rank, j in enumerate(best)]
    same_bag([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in results(9)], expected)


def test_whitening(spark, edge_dir, results):
    kept = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{edge_dir}/embeddings.parquet").collect()]
    kept = [(i, v) for i, v in kept if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([np.pad(np.floor(256 * np.array(v, float)), (0, 64 - len(v))) for _, v in kept]) + 0.0
    once = np.unique(x, axis=0)
    n, total = len(once), once.sum(0)
    covariance = np.cov(once.T, bias=True)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:4], vectors.T[::-1][:4]
    rows = results(11)
    same_bag([(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in rows],
             [(i, k, n, int(((n * v - total) ** 2).sum())) for (i, _), v in zip(kept, x) for k in (1, 2, 3, 4)])
    found = {(r["vec_id"], r["component"]): r for r in rows if r["vec_id"] is not None}
    for k in range(4):
        own = np.array([found[i, k + 1]["whitened"] for i, _ in kept if i is not None])
        expected = np.array([(v - total / n) @ vectors[k] / np.sqrt(values[k]) for (i, _), v in zip(kept, x) if i is not None])
        assert np.allclose(own, expected * np.sign(own @ expected), atol=1e-9)
        assert abs(found[kept[0][0], k + 1]["explained"] / (values[k] / np.trace(covariance)) - 1) < 1e-9
    assert max(r["identity_error"] for r in rows) < 1e-9


def test_repair(spark, edge_dir, results):
    talk = [tuple(r) for r in spark.read.parquet(f"{edge_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    same_bag([tuple(r[n] for n in names) for r in results(12)], brute.repaired(talk))


def test_vector_copies(spark, edge_dir, results):
    rows = sorted(((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{edge_dir}/embeddings.parquet").collect()),
                  key=lambda r: (r[0] is None, r[0] or 0))
    counts, first = brute.cosine_links([v for _, v in rows])
    expected = [(i, n, rows[f][0], i == rows[f][0]) for (i, _), n, f in zip(rows, counts, first)]
    same_bag([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in results(13)], expected)
    assert max(counts) >= 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    rows = QUERIES[name](spark, empty_dir).collect()
    assert [r["conv_id"] for r in rows] == [-7] if name.startswith("op3_") else rows == []


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(("op4_", "op8_"))])
def test_clashing_names(spark, clashing_dir, results, name):
    own = [tuple(r.values()) for r in results(int(name[2:].split("_")[0]))]
    found = [tuple(r.asDict().values()) for r in QUERIES[name](spark, clashing_dir).collect()]
    if name.startswith("op2_"):  # slots depend on the order of reading
        own, found = [r[:5] for r in own], [r[:5] for r in found]
    same_bag(found, own)


def test_pipeline_stages(spark, clashing_dir, tmp_path):
    docs = spark.read.parquet(f"{clashing_dir}/documents.parquet")
    columns = docs.columns
    verdict = {(r["doc_id"]): r["kept"] for r in BY_NUMBER[7](spark, clashing_dir).collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, clashing_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            assert {r["doc_id"] for r in docs.collect()} == {d for d, kept in verdict.items() if kept}
        if i == 2:
            given = sorted(((r["doc_id"], r["text"] or "") for r in before.collect()), key=lambda x: (x[0] is None, x[0] or 0))
            roots = brute.link_classes([brute.shingle_set(t) for _, t in given])
            same_bag([(r["doc_id"], r["text"] or "") for r in docs.collect()], [given[r] for r in sorted(set(roots))])
        if i == 3:
            texts = [r["text"] or "" for r in docs.collect()]
            assert not any(v for t in texts for v in brute.pii_base(t).values())
    assert docs.count() > 0


def test_pipeline_on_an_empty_table(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
