"""Alignments against both tokenizers run on whole texts, offsets compared one by one."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from labelforge.llm import alignment as L
from labelforge.llm import queries as Q
from labelforge.llm.common import table

A_PATH, B_PATH = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """A function from texts by id to the rows due, without segments."""
    a_model = Tokenizer.from_file(A_PATH)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}

    def ranges(parts):
        at, out = 0, []
        for x in parts:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    def one(text):
        if not text:
            return None
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        a_parts = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        b_parts = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            return None
        ra, rb = ranges(a_parts), ranges(b_parts)
        links, first = [], 0
        for i, (start, end) in enumerate(ra):
            while rb[first][1] <= start:
                first += 1
            j = first
            while j < len(rb) and rb[j][0] < end:
                links.append((a[i], b[j]))
                j += 1
        groups, low = [], 0
        for end in sorted({e for _, e in ra} & {e for _, e in rb}):
            groups.append(tuple(",".join(str(x) for x, (s, e) in zip(ids, at, strict=True) if low <= s and e <= end) for ids, at in ((a, ra), (b, rb))) if len(whole) < 3000 else None)
            low = end
        return len(a), len(b), groups, links

    def due(texts):
        each = {k: one(t) for k, t in texts.items()}
        counts = Counter(link for x in each.values() if x for link in x[3])
        best: dict[int, int] = {}
        for (_, b), n in counts.items():
            best[b] = max(best.get(b, 0), n)
        out = {}
        for k, x in each.items():
            if x is None:
                out[k] = (0, 0, 0, 0, 0, 0, "")
                continue
            n_a, n_b, groups, links = x
            digest = None if None in groups else hashlib.sha256(";".join(f"{u}|{v}" for u, v in groups).encode()).hexdigest()
            out[k] = (n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
        return out

    return due


def check(found, want):
    assert {r[0] for r in found} == set(want)
    for r in found:
        own = tuple(r)[1:]
        assert own[:6] == want[r[0]][:6], r[0]
        assert want[r[0]][6] in (None, own[6])


AWKWARD = {
    1: None,
    2: "",
    3: " ",
    4: "   two  spaces   and a tail  ",
    5: "lines\n\n  indented\tand\ttabs \n\n\n",
    6: "<|endoftext|> <s> </s> <unk> <0x41> plain",
    7: "mark ▁ inside",
    8: "naïve café ﬁ ½ 東京タワー \U0001f600\U0001f468‍\U0001f469 end",
    9: "no-break space 　wide em \x1c\x1d control\x00nul \x0b\x0c\r\n cr;\r\n",
    10: "it's they'll I'm 'S 123,456.78 ----- ===== ((()))",
    11: "x" * 5000,
    12: ("word " * 4000) + "end",
    13: "a" * 300 + " " * 300 + "b",
    14: "\n",
    15: "\nfirst",
    16: "é combining ་ tibetan ​ zero ﻿ bom",
    17: "lines\n\n  indented\tand\ttabs \n\n\n",
}


@pytest.mark.parametrize("options", [{}, {"most_sent": 0, "chunk_bytes": 500, "region": 3}, {"chunk_bytes": 1000, "region": 1}])
def test_awkward_texts(spark, plain, options):
    docs = spark.createDataFrame(list(AWKWARD.items()), "doc_id long, text string").repartition(3)
    check(L.align_documents(docs, A_PATH, B_PATH, **options).collect(), plain(AWKWARD))


def test_whole_table(spark, sf_dir, plain):
    docs = table(spark, sf_dir, "documents")
    check(Q.op12_alignment(spark, sf_dir).collect(), plain({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}))


def test_segments_give_the_tokens_of_whole_texts(spark, sf_dir):
    p = L.pair(A_PATH, B_PATH)
    assert " " in p.cuts and "\r" not in p.cuts  # pieces such as ";\r" merge across
    for text in [*AWKWARD.values(), *[r.text for r in table(spark, sf_dir, "documents").select("text").limit(60).collect()]]:
        if p.whole(text):
            parts = p.split(text)
            assert "".join(parts) == " " + text
            each = [p.encode([x]) for x in parts]
            assert [i for a, _ in each for i in a.tolist()] == p.a.encode(" " + text, add_special_tokens=False).ids
            assert [i for _, b in each for i in b.tolist()] == p.b.encode(text)
            solid = [x for x in parts if not x[-1].isspace()]
            assert [x.tolist() for x in p.encode(solid)] == [[i for e, x in zip(each, parts, strict=True) if not x[-1].isspace() for i in e[k].tolist()] for k in (0, 1)] if solid else True


def test_repeated_null_and_clashing_rows(spark, plain):
    rows = [(1, "same text here", "g"), (1, "same text here", "g"), (None, "same text here", "h"), (3, "▁", None)]
    found = L.align_documents(spark.createDataFrame(rows, "doc_id int, text string, n_a string"), A_PATH, B_PATH).collect()
    assert len(found) == 4 and len({tuple(r)[1:] for r in found}) == 2
    want = plain({0: rows[0][1], 1: rows[0][1], 2: rows[0][1]})[0]
    assert {tuple(r)[1:] for r in found if r.doc_id != 3} == {want}
    assert L.align_documents(spark.createDataFrame([], "doc_id int, text string"), A_PATH, B_PATH).count() == 0
