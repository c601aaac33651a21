"""Token output, chat, BPE, packing: exact round trips and library results."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import byte_bpe, chat, packing, simple8b, token_output, vocab
from quarry.llm import queries as q

ODD = ["a  b", "a \n b", "\n\nx", " x ", "it's a'll 'S", "É́ x́", "x\x1cy z", "a\tb c", "don't!!! $$$ <|endoftext|> ok", "", "  ", "\n", "a\nb\n c", "Straße ǅ İx ΑΣ ΑΣ. 日本", "a\r\nb", "end \n", "12 345 6", "½ ½x", "a,b, c.\nd", "word,, ,x", "x" * 3000, "a <|endoftext|> b", "a<|startoftext|>b <|ENDOFTEXT|>", "<|endoftext|>" * 3, "tail <|endoftext", "y" * 70 + " " + "y" * 70, None]
TABLE = "doc_id long, text string, start long, piece int, extra string"


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, 9, 9, "z") for i, t in enumerate(ODD)] + [(3, ODD[3], 9, 9, "z"), (None, "no id", 1, 1, None)]
    return spark.createDataFrame(rows, TABLE)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, first = simple8b.encode(v)
    assert (simple8b.decode(words, first, len(v)) == v).all()
    assert len(first) == -(-len(v) // simple8b.BLOCK)


def test_simple8b_packs_small_values_densely():
    words, _ = simple8b.encode(np.zeros(2400, np.uint64))
    assert len(words) <= 20
    words, _ = simple8b.encode(np.full(600, 2**63, np.uint64))  # escapes
    assert len(words) == 1200


def test_segment_round_trip():
    ids = np.arange(1000, dtype=np.uint32)
    data = simple8b.pack_segment([7, 9, 11], [500, 0, 500], ids)
    got = list(simple8b.unpack_segment(data))
    assert [(d, s, len(x)) for d, s, x in got] == [(7, 0, 500), (9, 500, 0), (11, 500, 500)]
    assert np.concatenate([x for _, _, x in got]).tolist() == ids.tolist()


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_chunked_encoding_equals_the_library(name, kind):
    encode, coder = library(name), vocab.ChunkEncoder(P.path(name), kind, limit=50)
    random.seed(3)
    texts = [t or "" for t in ODD] + ["".join(random.choice("ab ,.\n'é1$") for _ in range(random.randint(0, 40))) for _ in range(400)]
    for at in range(0, len(texts), 60):  # a small limit makes chunks be forgotten
        part = texts[at : at + 60]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(part)] == [encode(t) for t in part]


def test_op1_against_the_library(spark, odd_docs, tmp_path):
    encode = library("word_bpe_49k.json")
    segments = token_output.write_tokens(odd_docs, P.path("word_bpe_49k.json"), 2, shards=3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in token_output.digest_tokens(segments).collect())
    order = sorted([(-1, "no id"), (3, ODD[3]), *enumerate(ODD)], key=lambda r: r[0])
    want, start = [], 0
    for doc, text in order:
        ids = [*encode(text), 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    back = {r.doc_id: r.ids for r in token_output.read_tokens(segments).collect()}
    assert back[4] == [*encode(ODD[4]), 2]
    token_output.export_segments(segments, str(tmp_path))
    files = sorted(tmp_path.glob("*.s8b"))
    assert sum(1 for f in files for _ in simple8b.unpack_segment(f.read_bytes())) == len(order)


def test_op1_empty_table(spark):
    docs = spark.createDataFrame([], TABLE)
    assert token_output.digest_tokens(token_output.write_tokens(docs, P.path("word_bpe_49k.json"), 2)).count() == 0


def tiktoken_encoding():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op4_equals_tiktoken():
    bpe, enc = byte_bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), tiktoken_encoding()
    random.seed(1)
    texts = [t or "" for t in ODD] + ["a" * 5000, "aaaaabaaab" * 300, "".join(random.choice("abcde") for _ in range(20_000)), "ы日本語テキスト🙂" * 50]
    texts += ["".join(chr(random.choice([97, 98, 32, 10, 0xE9, 0x3B1, 0x4E00, 39, 115, 49])) for _ in range(random.randint(1, 60))) for _ in range(300)]
    for text in texts:
        ids = bpe.encode(text)
        assert ids == enc.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_op4_documents(spark, odd_docs):
    files, enc = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), tiktoken_encoding()
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(odd_docs, *files), *files).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        if r.doc_id is not None:
            assert r.ids == enc.encode_ordinary(ODD[r.doc_id] or "") and bytes(r.decoded) == (ODD[r.doc_id] or "").encode()
    assert byte_bpe.encode_documents(spark.createDataFrame([], TABLE), *files).count() == 0


def test_op4_needs_one_worker_a_task(spark, sf, odd_docs):
    """Ids are decoded where they were made, so that a core never holds two vocabularies."""
    files = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    assert byte_bpe.op4(spark, sf)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = byte_bpe.decode_documents(byte_bpe.encode_documents(odd_docs, *files), *files)
    together = byte_bpe.encode_documents(odd_docs, *files, decoded=True)
    key = lambda r: (r.doc_id is None, r.doc_id, r.ids)
    assert sorted(together.collect(), key=key) == sorted(apart.collect(), key=key)
    bpe = byte_bpe.coder(*files)
    assert bpe.decode([]) == b"" and bpe.decode_batch(bpe.tokens.slice(0, 0).cast("int32"), np.zeros(3, np.int64)).to_pylist() == [b"", b""]


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@given(st.integers(1, 100).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=150))))
@settings(max_examples=150, deadline=None)
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    used = {}
    for n, first, end, per, bin_, offset in packing.plan_bins(dict(Counter(lengths)), capacity):
        for k in range(end - first):
            used.setdefault(bin_ + k // per, []).append((offset + k % per * n, n))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == best_fit(lengths, capacity)


def test_op5_pieces_and_sequences(spark, odd_docs):
    encode = library("byte_bpe_50k.json")
    placed = packing.pack(odd_docs, P.path("byte_bpe_50k.json"), 0, capacity=16, with_ids=True)
    rows = placed.collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for doc in set(range(len(ODD))) - {3}:
        pieces = sorted(by[doc], key=lambda r: r.piece)
        assert [t for r in pieces for t in r.ids] == [*encode(ODD[doc]), 0]
        assert all(r.length == 16 for r in pieces[1:]) and pieces[0].length <= 16
    lengths = [r.length for r in rows]
    sequences = packing.sequences(placed).collect()
    assert len(sequences) == len(best_fit(lengths, 16))
    assert sorted(16 - len(s.ids) for s in sequences) == best_fit(lengths, 16)
    assert packing.pack(spark.createDataFrame([], TABLE), P.path("byte_bpe_50k.json"), 0).count() == 0


@given(st.text(alphabet=st.sampled_from(list("</s>[INST] SYSROLE\\a\n")), max_size=80), st.sampled_from(["user", "assistant", "system", "tool</s>", "", None]))
@settings(max_examples=300, deadline=None)
def test_chat_turns_round_trip(text, role):
    piece, begin, end = chat.format_turn(role, text)
    assert chat.parse_turn(piece) == (role or "", text)
    assert chat.unescape(piece[begin:end]) == text
    assert not any(c in piece[begin:end] for c in chat.CONTROLS)


def test_op3_conversations_across_partitions(spark):
    rows = [(5, t, ["user", "assistant"][t % 2], f"turn {t} </s>" if t % 5 else None, "x") for t in range(60)] + [(9, 0, "user", "only", "x"), (None, 0, "assistant", "free", "x"), (5, 60, None, "odd", "x"), (5, 60, None, "odd", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    pieces = chat.format_conversations(turns, partitions=6)
    assert pieces.select("conv_key").where("conv_key = 5").count() == 62
    got = {r.conv_id: r for r in chat.digest(pieces, chat.expand(pieces)).collect()}
    assert set(got) == {5, 9, None}
    want = sorted([r for r in rows if r[0] == 5], key=lambda r: (r[1], r[2] or "", r[3] or ""))
    text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in want)
    loss = "".join(r[3] or "" for r in want if r[2] == "assistant")
    assert (got[5].n_turns, got[5].turns_sha256) == (62, hashlib.sha256(text.encode()).hexdigest())
    assert (got[5].loss_chars, got[5].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[9].loss_chars == 0 and got[None].loss_chars == 4
    example = chat.render_examples(pieces).where("conv_id = 5 AND target_place = 3").first()
    assert example.context.endswith("<s>") and example.target == chat.escape("turn 3 </s>") and example.context.count("[INST]") == 2
    empty = chat.format_conversations(spark.createDataFrame([], turns.schema))
    assert chat.digest(empty, chat.expand(empty)).count() == 0


def test_registered_text_queries(spark, sf):
    found = q.queries()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert found["op1_simple8b_tokens"](spark, sf).count() == n
    assert found["op4_bitmap_queue_bpe"](spark, sf).count() == n
    assert found["op5_best_fit_packing"](spark, sf).select("doc_id").distinct().count() == n
    chats = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    assert found["op3_prefix_target_chat"](spark, sf).count() == chats + 1
