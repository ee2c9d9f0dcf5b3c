"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary matches of a text. Dynamic
programming over positions carries the best score and the piece count of the
best segmentation, nothing else. Ties follow the tokenizer: a path is replaced
only by one with a strictly better score, and candidates for a position come
by their start, smallest (so the longest piece) first. A position where no
one-character piece matches also offers the character as unknown, at the lowest
score of the vocabulary minus ``UNKNOWN_PENALTY``; with byte pieces, an
unknown character counts as its UTF-8 bytes.

Texts begin with a space mark, and spaces are space marks. No piece has a mark
after another character, so a best path passes every start of a run of marks
and the runs' counts can be added up. Where scores are whole numbers below 2^53,
sums are exact in any order. Log-probabilities are not: the tokenizer adds a piece's score to the
rounded score of all before it, so in a near tie the text before a run may decide. Each run's ``margin`` is the
least difference between a best score and one that lost to it; a run whose margin is beyond all rounding is segmented alike after any text and
is remembered with its pieces' scores, which are added one by one to what came before; any other run is segmented anew from the score before
it. So counts and scores are those of the whole text, to the last bit.

Defined results: a null or empty text has 0 tokens and score 0; repeated rows
give equal results; a null id is kept; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import text_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
RUNS = re.compile(f"{MARK}*[^{MARK}]*")
MOST_CACHED = 300_000
#: In texts of more characters no run of fractional scores is taken from memory.
MOST_CHARS = 1 << 24
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)


def vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, from a public vocabulary file; its scores are taken as unigram scores."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    kinds = ((sp.is_unknown, UNKNOWN), (sp.is_control, CONTROL), (sp.is_byte, BYTE))
    return [(sp.id_to_piece(i), sp.get_score(i), next((k for is_kind, k in kinds if is_kind(i)), NORMAL)) for i in range(sp.get_piece_size())]


class Counter(dict):
    """(pieces, scores of the pieces) of runs that are segmented alike after any text, None for other short runs; emptied when it holds ``MOST_CACHED`` runs.

    Where all scores are whole, the scores' sum stands for them.
    """

    def __init__(self, pieces: list[tuple[str, float, int]]):
        super().__init__()
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        scores = [score for _, score, _ in pieces]
        for piece, score, _ in pieces:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"a mark inside {piece!r}")
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.whole = all(score == int(score) for score in scores)
        self.largest = max(map(abs, [*scores, self.unknown]))
        self.bytes = any(kind == BYTE for _, _, kind in pieces)

    def viterbi(self, run: str, before: float = 0.0) -> tuple[int, float, list[float], float]:
        """Pieces of ``run``, their best score after a text of score ``before``, each piece's score, and the margin."""
        n = len(run)
        best: list[float | None] = [before] + [None] * n
        count = [0] * (n + 1)
        came: list[tuple[int, float]] = [(0, 0.0)] * (n + 1)  # start and score of the last piece
        done = 0  # positions up to here have all their candidates
        margin = float("inf")

        def offer(end: int, start: int, score: float, pieces: int) -> None:
            nonlocal margin
            total, held = best[start] + score, best[end]
            if held is not None:
                margin = min(margin, abs(total - held))
            if held is None or total > held:
                best[end], count[end], came[end] = total, count[start] + pieces, (start, score)

        def close(upto: int) -> None:
            """Offer unknown characters where no one-character piece matched."""
            nonlocal done
            while done < upto:
                done += 1
                if not single[done]:
                    offer(done, done - 1, self.unknown, len(run[done - 1].encode("utf-8", "surrogatepass")) if self.bytes else 1)

        single = bytearray(n + 1)
        for end, (length, score) in self.matches.iter(run):  # by end; at one end, longest first
            end += 1
            close(end - 1)
            if length == 1:
                single[end] = 1
            offer(end, end - length, score, 1)
        close(n)
        scores, at = [], n
        while at:
            at, score = came[at]
            scores.append(score)
        return count[n], best[n], scores[::-1], margin

    def exact(self, run: str) -> tuple[int, float]:
        """Pieces and best score of ``run`` where sums are exact: nothing else has to be kept."""
        n = len(run)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        done = 0
        single = bytearray(n + 1)

        def close(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if not single[done]:
                    score = best[done - 1] + self.unknown
                    if best[done] is None or score > best[done]:
                        best[done] = score
                        count[done] = count[done - 1] + (len(run[done - 1].encode("utf-8", "surrogatepass")) if self.bytes else 1)

        for end, (length, score) in self.matches.iter(run):
            end += 1
            close(end - 1)
            if length == 1:
                single[end] = 1
            score += best[end - length]
            if best[end] is None or score > best[end]:
                best[end] = score
                count[end] = count[end - length] + 1
        close(n)
        return count[n], best[n]

    def __missing__(self, run: str) -> tuple[int, object] | None:
        if self.whole:
            found = self.exact(run)
        else:
            pieces, _, scores, margin = self.viterbi(run)
            # sums stay below MOST_CHARS pieces' scores; each of a run's additions rounds by less than that times 2^-52
            found = (pieces, scores) if margin > 4 * (len(run) + 1) * MOST_CHARS * self.largest * 2.0**-52 else None
        if len(run) <= 64:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[run] = found
        return found

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        runs = [run for run in RUNS.findall(marked) if run]
        if self.whole:
            found = [self[run] for run in runs]
            return sum(n for n, _ in found), sum(s for _, s in found)
        pieces, total = 0, 0.0
        safe = len(marked) <= MOST_CHARS
        for run in runs:
            found = self[run] if safe else None
            if found is None:
                n, total, _, _ = self.viterbi(run, total)
            else:
                n = found[0]
                for score in found[1]:
                    total += score
            pieces += n
        return pieces, total


@cache
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_chars, n_tokens and score of each row."""

    def run(batches):
        for b in batches:
            found = [counter(vocab).count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["id", "n_chars", "n_tokens", "score"])

    text = text_of(text_col)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.char_length(text).cast("long").alias("n_chars"), text.alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_chars long, n_tokens long, score double").withColumnRenamed("id", id_col)
