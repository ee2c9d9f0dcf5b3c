"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is
parsed into phrases: each phrase is the longest match that the automaton allows
from where the last one ended (a letter unknown to it is a phrase). Phrases per
character times the logarithm of the training length estimate the cross
entropy. A length under ``LEAST_LENGTH`` counts as that: so little text has phrases of hardly
more than a letter, and by its own short length each would cost less than
a letter does in the right language. Then the language with the fewest normalised phrases wins; ties go to the
language that sorts first. The score is 1 minus the ratio of the winner's
phrases to the runner-up's (1 if there is one language only).

Texts are parsed whole, in windows of ``WINDOW`` characters that are parsed side
by side with numpy; a window's last phrase ends with it, for all languages
alike. Automata are fitted on a bounded sample: ``rows_per_language`` labelled
texts of each language, those with the smallest hash of id, and ``train_chars``
characters taken evenly from them, which bounds model and closure. Each language
has its own length; one with little text shortens no other.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a letter is any character that Unicode calls one. Without labelled rows all
texts are ``und``. Repeated rows get equal results, a null id is kept; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import slices

UND = "und"
WINDOW = 512
LEAST_LENGTH = 4_000
MOST_CELLS = 24_000_000
EVIDENCE = 64
GAP = 1  # the symbol of all that is no letter; 0 is a letter that training has not


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Alphabet:
    """Symbols of the letters of the training texts, most frequent first; upper case is lower case."""

    def __init__(self, texts: list[str]):
        counts: dict[str, int] = {}
        for text in texts:
            for c in text.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        self.letters = sorted(counts, key=lambda c: (-counts[c], c))  # the sample bounds them
        self.size = len(self.letters) + 2
        self.table = np.where(_letters(), 0, GAP).astype(np.uint8 if self.size < 256 else np.uint16 if self.size < 65_536 else np.uint32)
        for i, c in enumerate(self.letters):
            self.table[ord(c)] = i + 2
            if len(c.upper()) == 1:
                self.table[ord(c.upper())] = i + 2

    def symbols(self, text: str) -> np.ndarray:
        return self.table[_points(text)]


def suffix_moves(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton; state 0 is dead, 1 the start."""
    moves: list[dict[int, int]] = [{}, {}]
    length, link = [0, 0], [0, 0]
    last = 1
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def automaton(symbols: list[int], size: int) -> np.ndarray:
    """The moves as a table of states x symbols."""
    moves = suffix_moves(symbols)
    table = np.zeros((len(moves), size), np.int32)
    for s, row in enumerate(moves):
        for c, t in row.items():
            table[s, c] = t
    return table


class Moves:
    """Moves that never die: a dead end starts a phrase, so the move goes on from the start, marked by its sign.

    From the last state, which is that before a text and after an unknown letter, every move starts a phrase. Up to ``MOST_CELLS``
    cells are a table; for larger alphabets the same moves are kept sorted.
    """

    def __init__(self, symbols: list[int], size: int, most_cells: int = MOST_CELLS):
        self.size, moves = size, suffix_moves(symbols)
        self.last = len(moves)
        self.first = np.full(size, self.last, np.int32)
        self.first[list(moves[1])] = list(moves[1].values())
        states = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        keys = states * size + np.fromiter((c for m in moves for c in m), np.int64, len(states))
        to = np.fromiter((t for m in moves for t in m.values()), np.int32, len(states))
        self.table = self.keys = None
        if (len(moves) + 1) * size <= most_cells:
            self.table = np.tile(-self.first, len(moves) + 1)
            self.table[keys] = to
        else:
            order = np.argsort(keys)
            self.keys, self.to = np.append(keys[order], -1), np.append(to[order], 0)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state * self.size + symbol]
        wanted = state.astype(np.int64) * self.size + symbol
        at = np.searchsorted(self.keys[:-1], wanted)
        return np.where(self.keys[at] == wanted, self.to[at], -self.first[symbol])




class Model:
    def __init__(self, training: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in training]
        self.alphabet = Alphabet([text for _, text in training])
        self.moves, self.weights, self.own = [], [], []
        for _, text in training:
            symbols = self.alphabet.symbols(text).tolist()
            self.moves.append(Moves(symbols, self.alphabet.size))
            self.weights.append(math.log2(max(LEAST_LENGTH, len(symbols))))
            self.own.append(math.log2(max(2, len(symbols))))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language."""
        symbols = [self.alphabet.symbols(t) for t in texts]
        lengths = np.array([len(s) for s in symbols], np.int64)
        counts = np.maximum(1, -(-lengths // WINDOW))
        owner = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        wide = np.minimum(WINDOW, lengths[owner] - nth * WINDOW)
        order = np.argsort(-wide, kind="stable")
        flat = np.concatenate([*symbols, np.zeros(WINDOW, self.alphabet.table.dtype)])
        starts = (np.cumsum(lengths) - lengths)[owner] + nth * WINDOW
        lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[starts[order]].T)
        active = np.searchsorted(-wide[order], -np.arange(WINDOW), "left")
        out = np.empty((len(texts), len(self.langs)), np.int64)
        for k, move in enumerate(self.moves):
            state, found = np.full(len(owner), move.last, np.int32), np.zeros(len(owner), np.int32)
            for j in range(WINDOW):
                n = active[j]
                if not n:
                    break
                to = move(state[:n], lanes[j, :n])
                found[:n] += to < 0
                np.abs(to, out=state[:n])
            out[:, k] = np.bincount(owner[order], weights=found, minlength=len(texts)).astype(np.int64)
        return out

    def judge(self, texts: list[str | None], most_bits: float = 1.5) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the text is foreign to all languages.

        A foreign text costs, in its best language and without the phrases at its ends, over ``most_bits`` times
        as much as letters that follow no rule do (the logarithm of the alphabet's size for each character), by over ``EVIDENCE`` bits.
        A phrase costs the logarithm of the language's own length here, so what is learnt from little text rejects little.
        """
        langs, scores, foreign = [UND] * len(texts), [0.0] * len(texts), [False] * len(texts)
        letters = _letters()
        at = [i for i, t in enumerate(texts) if t and letters[_points(t)].any()] if self.langs else []
        for lo, hi in slices(at, 1_000_000, lambda i: len(texts[i])):
            part = at[lo:hi]
            found = self.phrases([texts[i] for i in part])
            cost = found * np.array(self.weights)
            best = cost.argmin(axis=1)
            for i, row, b, n in zip(part, cost, best, found[np.arange(len(part)), best], strict=True):
                langs[i] = self.langs[b]
                rest = np.delete(row, b)
                scores[i] = float(1 - row[b] / rest.min()) if len(rest) else 1.0
                foreign[i] = bool((n - 2) * self.own[b] > most_bits * math.log2(self.alphabet.size) * len(texts[i]) + EVIDENCE)
        return langs, scores, foreign

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]


@lru_cache(maxsize=2)
def model(training: tuple[tuple[str, str], ...]) -> Model:
    return Model(training)


def sample_training(docs: DataFrame, may_learn: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 200, train_chars: int = 40_000, most_languages: int = 200, salts: int = 64) -> tuple[tuple[str, str], ...]:
    """``((lang, text), ...)`` by language: the bounded sample that automata are fitted on.

    ``may_learn`` is a condition in SQL that says which rows may be learnt from. Rows without text or
    label are passed over. Of each language the ``rows_per_language`` texts with the smallest hash of their id are chosen; each gives at most four times its equal share of
    ``train_chars``, from its start, and they are taken in that order until ``train_chars`` are full. Only as much of a text is moved. The ``most_languages``
    labels with most rows are languages (ties by name); rarer labels, such as misspelt ones, are learnt by nobody, so models, the sample and what tasks hold are bounded whatever labels there are.
    """
    labelled = docs.filter(may_learn).select(F.col(f"`{lang_col}`").alias("lang")).filter("lang is not null")
    frequent = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).select("lang")
    share = max(64, 4 * train_chars // rows_per_language)
    read = docs.filter(may_learn).select(F.col(f"`{lang_col}`").alias("lang"), F.xxhash64(f"`{id_col}`").alias("h"), F.col(f"`{text_col}`").alias("text")).filter(r"lang is not null and rlike(text, '[\\p{L}]')")
    rows = read.join(F.broadcast(frequent), "lang", "left_semi").select("lang", "h", F.substring("text", 1, share).alias("text"))

    def smallest(of: DataFrame, *order: str) -> DataFrame:
        """The ``rows_per_language`` first of each language: of each salt, then of these, so no task reads a whole language."""
        for deal in (["lang", "salt"], ["lang"]):
            of = of.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)) if len(deal) > 1 else F.lit(0))
            of = of.withColumn("k", F.row_number().over(Window.partitionBy(*deal).orderBy(*order))).filter(F.col("k") <= rows_per_language)
        return of

    # hashes alone say which texts are fetched
    limits = smallest(rows.select("lang", "h"), "h").groupBy("lang").agg(F.max("h").alias("most"))
    chosen = smallest(rows.join(F.broadcast(limits), "lang").filter("h <= most").select("lang", "h", "text"), "h", "text")
    share = chosen.select("lang", "k", "text").orderBy("lang", "k").collect()
    texts: dict[str, str] = {}
    for r in share:
        texts[r["lang"]] = f"{texts.get(r['lang'], '')} {r['text']}" if len(texts.get(r["lang"], "")) < train_chars else texts[r["lang"]]
    return tuple((lang, texts[lang][:train_chars]) for lang in sorted(texts))


def identify(docs: DataFrame, training: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` for each row of ``docs``."""

    def run(batches):
        for b in batches:
            langs, scores = model(training).predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, training: tuple[tuple[str, str], ...], text_col: str = "text", most_bits: float = 1.5) -> DataFrame:
    """The rows of ``docs`` that are in some language, with all their columns: neither ``und`` nor foreign to all (see ``Model.judge``).

    Where no language could be learnt, rows with a letter stay.
    """
    names = docs.columns
    if not training:
        return docs.filter(F.col(f"`{text_col}`").rlike("\\p{L}"))

    def run(batches):
        for b in batches:
            langs, _, foreign = model(training).judge(b.column(names.index(text_col)).to_pylist(), most_bits)
            yield b.filter(pa.array([x != UND and not f for x, f in zip(langs, foreign, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
