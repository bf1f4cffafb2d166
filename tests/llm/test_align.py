"""Token alignment against every pair of tokens, compared byte by byte."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import align

SCHEMA = "doc_id long, text string"
TEXTS = [
    None, "", " ", "a", "Hello world, it's 2024!", "Hello world, it's 2024!", "naïve café – “quoted” — ½ 漢字 🙂 тест", "<|endoftext|> and </s> and <unk>", "holds ▁ itself",
    "tabs\tand\nlines\r\n\n  spaces   end  ", "x" * 3000, " " * 500 + "deep", "é   ​ \u0085z", "\x00\x01 control", "Donaudampfschifffahrt der " * 40,
]


def by_hand(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def tokens(text):
        raw = (" " + text).encode()
        a, at = [], 0
        # The byte-level letters are those of the library's own alphabet: ask it for each token's bytes.
        for i in t.encode(" " + text, add_special_tokens=False).ids:
            n = len(align.sides(*align.default_tokenizers()).a_bytes[i])
            a.append((i, at, at + n))
            at += n
        b, at, said = [], 0, b""
        for i in p.encode(text):
            piece = p.id_to_piece(i)
            piece = bytes([int(piece[3:5], 16)]) if p.is_byte(i) else piece.replace("▁", " ").encode()
            b.append((i, at, at + len(piece)))
            at, said = at + len(piece), said + piece
        return (a, b) if said == raw and (not a or a[-1][2] == len(raw)) else ([], [])

    held, docs = [], []
    for doc, text in rows:
        a, b = tokens(text) if text else ([], [])
        links = [(i, j) for i, x, y in a for j, u, v in b if x < v and u < y]
        both = sorted({y for *_, y in a} & {v for *_, v in b})
        groups, was = [], 0
        for end in both:
            part = lambda side: ",".join(str(i) for i, x, y in side if was <= x and y <= end)  # noqa: B023,E731
            groups.append(f"{part(a)}|{part(b)}")
            was = end
        docs.append((doc, len(a), len(b), groups, links))
        held.append(set(links))
    counts = Counter(x for h in held for x in h)
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = []
    for doc, n_a, n_b, groups, links in docs:
        text = ";".join(groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(spark, sf):
    some = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 700").collect()]
    return [*enumerate(TEXTS, 1000), *some, (1004, "shared id"), (None, "Hello world"), (None, None)]


@pytest.fixture(scope="module")
def wanted(rows):
    return by_hand(rows)


@pytest.mark.parametrize("head, counted, chunk", [(1 << 20, 4 << 20, 1 << 20), (40, 500, 300), (0, 64, 1)])
def test_every_link(spark, rows, wanted, head, counted, chunk, monkeypatch):
    monkeypatch.setattr(align, "HEAD", head)
    monkeypatch.setattr(align, "COUNTED", counted)
    monkeypatch.setattr(align, "CHUNK", chunk)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as row", "2 as pairs", "3 as n")
    got = align.alignment_digest(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == wanted


def test_token_bytes_decode():
    s = align.sides(*align.default_tokenizers())
    for text in filter(None, TEXTS):
        ids = s.slow.encode(" " + text, add_special_tokens=False).ids
        assert b"".join(s.a_bytes[i] for i in ids).decode() == " " + text
        if s.fast and align._PLAIN.fullmatch(text):
            assert s.fast.encode_ordinary(" " + text) == ids


def test_groups_are_real_outputs(spark):
    row = align.align(spark.createDataFrame([(1, "aligned tokens")], SCHEMA)).first()
    a, b = zip(*(g.split("|") for g in row["groups"].split(";")))
    s = align.sides(*align.default_tokenizers())
    side = lambda groups, table: [b"".join(table[int(i)] for i in g.split(",")) for g in groups]
    assert side(a, s.a_bytes) == side(b, s.b_bytes)


def test_empty(spark):
    assert align.alignment_digest(spark.createDataFrame([], SCHEMA)).count() == 0
