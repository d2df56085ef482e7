"""Token counts by spliced chunks, alignment of two tokenizers, and collocations, against plain versions."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm import alignment, collocations, token_counts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, n string, key string, score int"
WORDS = "the quick brown fox isn't jumping over 12345 lazy dogs at <|endoftext|> über naïve 東京 x=1; (foo) {\r\n} don't ''' ▁   a1b2c3".split(" ")


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(5)
    long = "".join(draw.choice(WORDS) + draw.choice([" ", "  ", "\n", " \n ", "\t", ""]) for _ in range(3000))
    texts = ["plain words of a text", "plain words of a text", None, "", " ", "\n\n  a", "trailing   ", "a\r\nb;\r\nc \r d", "<|endoftext|> <s> </s>", long, "ab" * 3000, "東京都" * 700, "word▁glue and more"]
    rows = [(k if k != 3 else None, t, None if k == 5 else "en", "s", 1, k, "x", "y", 3) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# -- 13 -------------------------------------------------------------------------------------------------------------------
def plain_count(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        return lambda t, m=sentencepiece.SentencePieceProcessor(model_file=path): len(m.encode(t))
    return lambda t, m=Tokenizer.from_file(path): len(m.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_spliced_chunks(odd, docs, name):
    """Chunks of 200 characters and overlaps of 24, so that many seams have to be widened."""
    count = plain_count(name)
    path = public_tokenizers.path(name)
    for rows, chunk, overlap in ((odd, 200, 24), (docs.limit(60), 300, 40)):
        found = token_counts.count_tokens(rows, path=path, chunk=chunk, overlap=overlap).collect()
        plain = [(r.doc_id, len((r.text or "").encode()), n := count(r.text or ""), n > 1024) for r in rows.collect()]
        assert Counter(map(tuple, found)) == Counter(plain)


def test_seams_of_chunks():
    own = token_counts.counter(None)
    text = "some words 12ab and " * 40
    chunks = token_counts.cut_chunks(text, 100, 30)
    assert "".join(t[:100] for _, t in chunks[:-1]) + chunks[-1][1] == text and all(text.startswith(t, s) for s, t in chunks)
    parts = []
    for k, (start, part) in enumerate(chunks):
        spans = own.spans(part)
        heads = [token_counts.seam_counts(own, part, spans, start, at, 30) if there else b"" for at, there in ((0, k), (100, k < len(chunks) - 1))]
        parts.append((len(spans[0]), *heads))
    assert token_counts.spliced(parts) == plain_count("byte_bpe_50k.json")(text)
    assert token_counts.spliced([(5, b"", b""), (6, b"", b"")]) is None  # no common place: to be widened
    assert not own.stable_positions("<|endoftext|>", 0, 13) and not own.stable_positions("isn't", 0, 5)


def test_counts_of_all_documents(docs):
    count = plain_count("byte_bpe_50k.json")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = token_counts.count_tokens(docs).collect()
    assert len(found) == len(texts) and all(r.n_tokens == count(texts[r.doc_id]) and r.over_limit == (r.n_tokens > 1024) for r in found)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, chunk=10, overlap=11)


# -- 11 -------------------------------------------------------------------------------------------------------------------
def plain_alignment(rows):
    """Whole texts under both libraries; every link kept."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    made, seen = [], Counter()
    for key, text in rows:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            one, two = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            left = [bytes(byte_of[c] for c in t) for t in one.tokens]
            right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(two, map(b.id_to_piece, two))]
            if b"".join(left) == b"".join(right) == (" " + text).encode():
                ends = [[sum(map(len, side[: k + 1])) for k in range(len(side))] if len(side) < 300 else None for side in (left, right)]
                for k, side in enumerate((left, right)):
                    if ends[k] is None:
                        total, ends[k] = 0, []
                        for t in side:
                            total += len(t)
                            ends[k].append(total)
                where = {e: k for k, e in enumerate(ends[1])}
                n_a, n_b, i, j = len(one.ids), len(two), 0, 0
                for p, e in enumerate(ends[0]):
                    if e in where:
                        q = where[e]
                        links.append((one.ids[p], two[q]))
                        groups.append(",".join(map(str, one.ids[i : p + 1])) + "|" + ",".join(map(str, two[j : q + 1])))
                        i, j = p + 1, q + 1
        seen.update(links)
        made.append((key, n_a, n_b, groups, links))
    most = defaultdict(int)
    for (_, y), n in seen.items():
        most[y] = max(most[y], n)
    return [
        (key, n_a, n_b, len(groups), len(links), sum(seen[p] == most[p[1]] for p in links), sum(seen[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for key, n_a, n_b, groups, links in made
    ]


@pytest.mark.parametrize("block", [500, alignment.BLOCK])
def test_alignment_against_whole_texts(odd, docs, block):
    rows = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    found = alignment.align_tokenizers(rows, block_bytes=block).collect()
    assert Counter(map(tuple, found)) == Counter(plain_alignment(map(tuple, rows.collect())))


def test_alignment_of_odd_rows(odd, docs):
    found = {r.doc_id: r for r in alignment.align_tokenizers(odd).collect()}
    assert found[2].n_a == found[12].n_links == 0 and found[12].groups_sha256 == "" and found[4].n_groups > 0
    assert alignment.align_tokenizers(docs.limit(0)).count() == 0
    assert alignment.align_tokenizers(odd.filter("text is null")).select("n_a", "groups_sha256").first() == (0, "")


def test_every_segment_is_whole():
    draw = random.Random(3)
    own = alignment.aligner(None, None)
    for _ in range(200):
        text = " " + "".join(draw.choice(WORDS) + draw.choice(["", " ", "\n", "\r", "　", " \r\n\t"]) for _ in range(20))
        assert "".join(own.cut(text)) == text


# -- 12 -------------------------------------------------------------------------------------------------------------------
def plain_collocations(rows, least, top, words=3):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            counts.update((lang, tuple(ws[i : i + k])) for k in range(1, words + 1) for i in range(len(ws) - k + 1))
    found = defaultdict(list)
    frequent = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    for (lang, ws), a in frequent.items():
        score, k, l, r = min((10**6 * a * a // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k, counts[lang, ws[:k]], counts[lang, ws[k:]]) for k in range(1, len(ws)))
        inside = (b for (g, v), b in frequent.items() if g == lang and len(v) > len(ws) and any(v[i : i + len(ws)] == ws for i in range(len(v))))
        if not any(100 * b >= 50 * a for b in inside):
            found[lang].append((-score, -a, " ".join(ws).encode(), l, r))
    return [(g, k, p.decode(), -a, l, r, n[g], -s) for g, rows in found.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]


def test_collocations_against_plain_counts(spark, odd, monkeypatch):
    draw = random.Random(11)
    vocabulary = ["new", "york", "city", "San", "francisco", "café", "zürich", "a", "of", "the"]
    texts = ["".join(draw.choice(vocabulary) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ", ", " "]) for _ in range(draw.randrange(60))) for _ in range(120)]
    rows = [(t, draw.choice(["en", "de", None, ""])) for t in texts] + [("a a a a a a", "en")] * 5
    made = spark.createDataFrame(rows, "text string, lang string").repartition(3).unionByName(odd.select("text", "lang"))
    for words, block, bits, each in ((3, 50, 1 << 15, 8), (3, collocations.BLOCK, collocations.BITS, 8), (4, 700, 1 << 15, 1 << 15)):
        monkeypatch.setattr(collocations, "BITS_EACH", each)  # the last: too few bits for the phrases, blocks ask by a join
        found = collocations.collocations(made, least=4, top=40, block_words=block, words=words, bits=bits)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == sorted(plain_collocations(map(tuple, made.collect()), 4, 40, words))


def test_collocations_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = collocations.op12_collocations(spark, folder)
    rows = sorted(con.sql(collocations.SQL).fetchall())
    assert len(rows) > 100 and sorted(map(tuple, found.collect())) == rows


def test_long_texts_are_cut_between_pieces():
    raw = b"one two. three four, five six seven. eight"
    assert b"".join(collocations._slices(raw, 5)) == raw and len(list(collocations._slices(raw, 5))) > 2
    assert all(re.search(rb"[.,]$", s) for s in list(collocations._slices(raw, 5))[:-1])


def test_collocations_of_odd_rows(spark, odd):
    assert collocations.collocations(odd.limit(0)).count() == 0
    assert collocations.collocations(odd.filter("text is null")).count() == 0
    scored = collocations.score_phrases(spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 1, 2 * 10**12), ("en", "a b", 2, 10**12)], "lang string, phrase string, size int, n long"))
    assert scored.first().score == 10**6 // 6
