"""Texts made to be hard: equal polynomial hashes, nested keywords, long runs, labels without documents."""

import random
import time

import numpy as np
import pytest

from chirpline.llm import hashing, neardup, quality, secrets, token_counts, token_files, tokens


def thue_morse(n):
    """A word and its complement, equal under every polynomial hash modulo 2 ** 64 with an odd base."""
    x = [0]
    while len(x) < n:
        x += [1 - v for v in x]
    return bytes(97 + v for v in x), bytes(98 - v for v in x)


TWINS = thue_morse(4096)


def library_ids(raw):
    return tokens.encoder(tokens.tokenizer_path()).library.tok.encode(raw.decode(), add_special_tokens=False).ids


def test_twins_have_their_own_ids():
    enc = tokens.ChunkEncoder(tokens.tokenizer_path(), 3)
    for texts in (list(TWINS), [TWINS[1]], [b" ".join(TWINS), TWINS[0]], [b"a b cdefghi cdefghij a" * 3]):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == [library_ids(t) for t in texts]


def test_chunks_are_told_apart_by_their_bytes():
    raw = b"a ab a\0 abcdefg abcdefgh abcdefg\0 \xff\xff\xff\xff\xff\xff\xff a " + b" ".join(TWINS)
    starts, h = hashing.chunk_hashes(raw)
    words = raw.split()
    assert len(starts) == len(words) and len(set(h.tolist())) == len(set(words)) and h[0] == h[7]
    assert [len(x) for x in hashing.chunk_edges(b"")] == [0, 0] and len(hashing.chunk_hashes(b" \n ")[0]) == 0


def test_twins_are_no_copies(spark, tmp_path):
    rest = " w1 w2 w3 w4"
    docs = spark.createDataFrame([(i, t.decode() + rest) for i, t in enumerate(TWINS)], "doc_id long, text string")
    a, b = neardup.shingle_sets([t + rest.encode() for t in TWINS])
    assert a.tolist() != b.tolist()
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == {0: 0, 1: 1}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    n = {r.doc_id: r.n_tokens for r in token_counts.op7_prefix_token_counts(spark, str(tmp_path)).collect()}
    assert n == {i: len(library_ids(t + rest.encode())) for i, t in enumerate(TWINS)}
    crc = {r.doc_id: r.ids_crc32 for r in token_files.op1_token_id_files(spark, str(tmp_path)).collect()}
    assert crc[0] != crc[1]


def test_prefix_programme_equals_the_library():
    lib = token_counts.Prefixes(tokens.tokenizer_path())
    rng = random.Random(9)
    pieces = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 40))) for _ in range(150)] + ["a" * 30, "ab" * 20, "=-" * 20, "." * 40, "éñ中ж" * 5, "İx", "xİy", "don't", "'re're", "<|endoftext|>x", "q̣̇z", "각", "²½5"]
    for p in pieces:
        got, at = np.frombuffer(lib.ids([p.encode()])[0], "<u4"), 0
        for i, c in enumerate(p):
            at += len(c.encode())
            assert got[at - 1] == len(library_ids(p[: i + 1].encode())), (p, i)


def test_one_piece_and_many_pieces_agree():
    lib = token_counts.Prefixes(tokens.tokenizer_path())
    rng = random.Random(10)
    pieces = list({"".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 60))) for _ in range(200)})
    assert [np.frombuffer(x, "<u4").tolist() for x in lib.merges.many(pieces)] == [lib.merges.counts(p).tolist() for p in pieces] and lib.merges.many([]) == []


def test_long_pieces_need_no_text():
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    enc = tokens.ChunkEncoder(tokens.tokenizer_path(), library=token_counts.Prefixes(tokens.tokenizer_path()))
    for t in (text, "=" * 100_000):
        start = time.process_time()
        raw = next(iter(enc.payloads([t.encode()])))
        assert time.process_time() - start < 60
        steps, *lists = token_counts.text_table(t.encode(), np.frombuffer(raw, "<u4"))
        row = {"steps": steps.tobytes(), **dict(zip(("block_tokens", "long_ends", "long_tokens"), (x.tolist() for x in lists)))}
        for at in (1, 200, 5_000, 100_000):
            assert token_counts.tokens_upto(row, at) == len(library_ids(t[:at].encode()))
        got = token_counts.truncate(row, t.encode(), 500)
        counts = token_counts._counts(row, 0, len(t))
        assert len(got) == max(np.flatnonzero(counts <= 500)) + 1


def test_open_pieces_say_so():
    enc = tokens.ChunkEncoder(tokens.tokenizer_path(), library=token_counts.Prefixes(tokens.tokenizer_path()))
    text = "x" + "̣̇" * 200
    steps, *lists = token_counts.text_table(text.encode(), np.frombuffer(next(iter(enc.payloads([text.encode()]))), "<u4"))
    row = {"steps": steps.tobytes(), **dict(zip(("block_tokens", "long_ends", "long_tokens"), (x.tolist() for x in lists)))}
    at = len(text[:300].encode())
    with pytest.raises(ValueError):
        token_counts.tokens_upto(row, at)
    assert token_counts.tokens_upto(row, at, text.encode()) == len(library_ids(text[:300].encode()))


@pytest.mark.parametrize("text", [b"token=" * 170_000, b"pwd:" * 250_000, b"pwd=pwd: " * 100_000, b"://a:" * 200_000, b"secret=" + b"xK9z" * 250_000])
def test_nested_keywords_take_linear_time(text):
    start = time.process_time()
    secrets.spans(text)
    assert time.process_time() - start < 90


def test_values_of_one_end_are_priced_as_alone():
    for value in ("pwd:token=kX9$vQ2!mZ7#pL4", "aaaaaaaatoken=qwerty1990", "secret=secret=Zk8"):
        costs = secrets.suffix_costs(value)
        for i in range(len(value)):
            alone = secrets.guess_cost(value[i:])
            assert alone - 1e-9 <= costs[i] <= alone + 12  # the logarithm is that of the whole stretch
        assert abs(costs[0] - secrets.guess_cost(value)) < 1e-9


def test_no_document_makes_its_own_word_common(spark):
    kind = "doc_id long, text string"
    secret = "kqzxvwjhtrpl"
    for n in (1, 3, 100):  # copies of one text
        docs = spark.createDataFrame([(i, f"pwd: {secret}") for i in range(n)], kind)
        words = secrets.common_words(docs)
        assert secret not in words.bits
        assert all(any(s.kind == "guess" for s in r.secrets) for r in secrets.find_secrets(docs, words=words).collect())
    many = spark.createDataFrame([(i, f"the word {secret} is in text {i}") for i in range(40)], kind)
    assert secret in secrets.common_words(many).bits


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(300)], "doc_id long, text string")
    labels = spark.range(200_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    space = quality.fit(docs, labels, references=150)
    assert len(space.labels) == 150
