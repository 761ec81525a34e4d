"""The corpus pipeline against the same stages in plain Python."""

import math
import zlib

import numpy as np
import public_tokenizers
import xxhash
from test_dedup import brute_components, brute_passages

import corpus_pipeline
from tracewright.llm import mixing


def test_run_against_plain_python(spark):
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    source = {i: s for i, _, s in rows}
    lettered = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    alone = brute_components(lettered, 5, 80)
    kept = [(i, t) for i, t in lettered if alone[i][2]]
    cut = brute_passages(kept, 20)
    left = {i: t if not cut[i][1] else cut[i][3] for i, t in kept if not cut[i][1] or cut[i][3]}
    signed = lambda i: (xxhash.xxh64_intdigest(str(i).encode(), seed=42) + 2**63) % 2**64 - 2**63
    queues = {}
    # The hash's leading bits are taken unsigned, so negative hashes come last.
    for i in sorted(left, key=lambda i: (signed(i) % 2**64 >> 56, signed(i), i)):
        queues.setdefault(source[i], []).append(i)
    weights, order = mixing.tempered({s: len(q) for s, q in queues.items()}, 0.5, max(1000, 4 * len(queues))), []
    while queues:
        g = math.gcd(*(weights[s] for s in queues))
        slots, over = mixing.frame({"s" + s: weights[s] // g for s in queues}), False
        while not over:
            for s in slots:
                s = s[1:]
                order += queues[s][:16]
                queues[s] = queues[s][16:]
                if over := not queues[s]:
                    del queues[s]
                    break
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scratch = corpus_pipeline.Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = scratch.keep(out, name)
    mixed = mixing.numbered(docs).collect()
    assert {x["doc_id"]: x["text"] for x in mixed} == left
    assert [x["doc_id"] for x in sorted(mixed, key=lambda x: x["_position"])] == order
    got = corpus_pipeline.run(spark, folder).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in left.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want |= {(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(got) == len(want)
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert (one.offset == one.length.cumsum() - one.length).all() and one.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
