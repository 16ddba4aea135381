"""Token counts of a unigram model by dynamic programming over a shared trie.

A text is cut into pre-tokens at white space; each gets the word-start mark in
front. The unigram model picks the segmentation of a pre-token with the
highest sum of piece scores. The best score of a prefix depends on nothing
after it, so the distinct pre-tokens go into a trie and each node, a shared
prefix, is scored once; a word's token count is stored at its last node.

The pieces are those of a tokenizer's file and stay as they are. The file only
ranks them, so their probabilities are estimated from the corpus: all words are
counted (a map-side count, then one shuffle of distinct words), and in each
round of expectation maximisation every distinct word adds the expected uses of
its pieces over all its segmentations (a map; as many rows as there are pieces
come to the driver). The rounds start from Zipf's law over the ranks.

Counting is one map over the documents: no shuffle, and the vocabulary is the
only broadcast (its size is that of the tokenizer). A task gathers the words it
has no count for yet, sorts them, and scores their trie level by level: the
words of one prefix lie together, so a level is a few array operations over its
nodes. Counts are forgotten when they are more than ``max_words``, tries hold
``LOT`` words at most, and words of more than ``LONG`` letters are scored singly
in a buffer of the longest piece; none of these changes a count.

Edge cases: null and empty texts have no words and no tokens; a character the
vocabulary lacks costs one byte token for each UTF-8 byte; without any words
the probabilities stay Zipf's; an empty table gives an empty result; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limber.llm.common import written

#: The mark of a word's start in the vocabulary's pieces.
WORD_START = "▁"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Counts of words that a task keeps, words of a trie, and words of texts that are looked at together.
MAX_WORDS, LOT, GROUP = 1_000_000, 100_000, 500_000
#: Longer words are scored beside the trie, and enter the estimate one letter after the other: other buffers, the same numbers.
LONG = 48
#: Rounds of the estimate, and the uses that every piece has besides those found.
ROUNDS, PRIOR = 2, 0.1
#: Words of one length whose segmentations are weighed at once.
AT_ONCE = 4096
#: Distinct words that a task counts before it hands them on.
MAX_COUNTED = 500_000


def unigram_scores(model_file: str = TOKENIZER) -> dict[str, float]:
    """Piece to log-probability by the ranks of the file: Zipf's, 1/(rank + 1), normalised. Where the estimate starts."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    ranked = sorted(ids, key=lambda i: (-sp.get_score(i), i))
    norm = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    return {sp.id_to_piece(i): -math.log(r + 1) - norm for r, i in enumerate(ranked)}


class ForwardTrie:
    """Nodes are prefixes of a sorted list of words; each has the best score of its prefix and the tokens of that segmentation.

    A node looks only at the pieces that end where it ends, found by the hash of
    their letters from the last one on, and the search stops at the first suffix
    that no piece has.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.longest = max(map(len, scores), default=1)
        by_length: dict[int, list[str]] = {}
        for piece in scores:
            by_length.setdefault(len(piece), []).append(piece)
        hashes, found = [np.zeros(1, dtype=np.uint64)], [np.full(1, np.nan)]
        for n, pieces in by_length.items():
            letters = np.array([list(map(ord, p)) for p in pieces], dtype=np.uint64)
            h = np.zeros(len(pieces), dtype=np.uint64)
            for back in range(1, n + 1):
                h = _next(h, letters[:, n - back])
                hashes.append(h)
                found.append(np.array([scores[p] for p in pieces]) if back == n else np.full(len(pieces), np.nan))
        every, score = np.concatenate(hashes), np.concatenate(found)
        order = np.lexsort((np.isnan(score), every))  # of a suffix that is a piece too, the piece
        first = np.r_[True, every[order][1:] != every[order][:-1]]
        self.hashes, self.scores = every[order][first], score[order][first]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are those of a piece's suffix, and the scores of the pieces, NaN where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return known, np.where(known, self.scores[at], np.nan)

    def tokens_of(self, words: list[str]) -> np.ndarray:
        """Tokens of the best segmentation of each of the sorted, distinct words; of equally good ones that whose last piece is longest, and so on."""
        n, length = len(words), np.array(list(map(len, words)), dtype=np.int64)
        width = int(length.max(initial=0))
        letters = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(n, width).astype(np.uint64)
        shared = np.full(n, -1, dtype=np.int64)  # letters that a word has in common with the one before it
        if n > 1:
            shared[1:] = (letters[1:] != letters[:-1]).argmax(axis=1)
        out = np.zeros(n, dtype=np.int64)
        levels = deque([(np.zeros(n, dtype=np.int64), np.zeros(1), np.zeros(1, dtype=np.int64))], maxlen=self.longest)  # node of each word, best score and tokens of each node
        for depth in range(1, width + 1):
            at = np.flatnonzero(length >= depth)
            new = shared[at] < depth
            new[:1] = True
            node = np.full(n, -1, dtype=np.int64)
            node[at] = np.cumsum(new) - 1
            word = at[new]  # one of each node's words
            best, tokens = np.full(len(word), -np.inf), np.zeros(len(word), dtype=np.int64)
            h, alive = np.zeros(len(word), dtype=np.uint64), np.arange(len(word))
            plain = np.zeros(len(word), dtype=bool)
            for back in range(1, min(depth, self.longest) + 1):
                h = _next(h, letters[word[alive], depth - back])
                known, score = self.find(h)
                is_piece = ~np.isnan(score)
                if back == 1:
                    plain = is_piece
                of = alive[is_piece]
                nodes, scores, counts = levels[-back]
                before = nodes[word[of]]
                total = scores[before] + score[is_piece]
                better = total >= best[of]
                best[of[better]], tokens[of[better]] = total[better], counts[before[better]] + 1
                h, alive = h[known], alive[known]
                if not len(alive):
                    break
            odd = np.flatnonzero(~plain)
            if len(odd):
                nodes, scores, counts = levels[-1]
                before = nodes[word[odd]]
                total, letter = scores[before] + self.unknown, letters[word[odd], depth - 1]
                better = total > best[odd]
                n_bytes = 1 + (letter >= 0x80) + (letter >= 0x800) + (letter >= 0x10000)
                best[odd[better]], tokens[odd[better]] = total[better], (counts[before] + n_bytes)[better]
            levels.append((node, best, tokens))
            ends = at[length[at] == depth]
            out[ends] = tokens[node[ends]]
        return out


class LongWords:
    """The same for single words of any length, in buffers of the longest piece."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.longest = max(map(len, scores), default=1)
        self.suffixes: dict[str, float | None] = {piece[i:]: None for piece in scores for i in range(1, len(piece))} | scores

    def tokens_of(self, word: str) -> int:
        """Only the last prefixes, as many as the longest piece has letters, are kept."""
        last: deque[tuple[float, int]] = deque([(0.0, 0)], maxlen=self.longest)  # of prefixes end - 1, end - 2, ...
        suffixes = self.suffixes
        for end, letter in enumerate(word, 1):
            best, tokens = -math.inf, 0
            for back, (total, n) in enumerate(last, 1):
                piece = word[end - back : end]
                if piece not in suffixes:
                    break
                score = suffixes[piece]
                if score is not None and total + score >= best:
                    best, tokens = total + score, n + 1
            if suffixes.get(letter) is None and last[0][0] + self.unknown > best:
                best, tokens = last[0][0] + self.unknown, last[0][1] + len(letter.encode())
            last.appendleft((best, tokens))
        return last[0][1]

    def uses_of(self, word: str) -> dict[str, float]:
        """How often each piece is used, over all segmentations by their probability; as :func:`expected_uses`, one letter after the other. Eight bytes a letter are kept.

        Forward chances are scaled to 1 at each place; the scales are what is
        kept. Going back, what a piece adds to the chance at its start is how
        often it is used there.
        """
        suffixes, longest = self.suffixes, self.longest
        unknown, scale = math.exp(self.unknown), array("d", [1.0])
        for end, letter in enumerate(word, 1):
            total, step = 0.0, 1.0
            for back in range(1, min(end, longest) + 1):
                if back > 1:
                    step *= scale[end - back + 1]
                piece = word[end - back : end]
                if piece not in suffixes:
                    break
                score = suffixes[piece]
                if score is not None:
                    total += math.exp(score) / step
            if suffixes.get(letter) is None:
                total += unknown
            scale.append(max(total, 1e-300))
        uses: dict[str, float] = {}
        after: deque[float] = deque([1.0] + [0.0] * longest)  # chances at end, end - 1, ...
        for end in range(len(word), 0, -1):
            here, step = after[0], 1.0
            for back in range(1, min(end, longest) + 1):
                step *= scale[end - back + 1]
                piece = word[end - back : end]
                if piece not in suffixes:
                    break
                score = suffixes[piece]
                if score is not None:
                    share = math.exp(score) * here / step
                    uses[piece] = uses.get(piece, 0.0) + share
                    after[back] += share
            if suffixes.get(word[end - 1]) is None:
                after[1] += unknown * here / scale[end]
            after.popleft()
            after.append(0.0)
        return uses


class PieceTable:
    """Pieces and their prefixes by the 64-bit hash of their letters, with the pieces' probabilities."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.pieces = list(scores)
        self.longest = max(map(len, self.pieces), default=1)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces):
            by_length.setdefault(len(p), []).append(i)
        hashes, numbers = [], []
        for n, at in by_length.items():
            letters = np.array([list(map(ord, self.pieces[i])) for i in at], dtype=np.uint64)
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(n):
                h = _next(h, letters[:, j])
                hashes.append(h)
                numbers.append(np.array(at) if j == n - 1 else np.full(len(at), -1))
        every, number = np.concatenate(hashes), np.concatenate(numbers)
        order = np.lexsort((-number, every))  # of a prefix that is a piece too, the piece
        first = np.r_[True, every[order][1:] != every[order][:-1]]
        self.hashes, self.numbers = every[order][first], number[order][first]
        self.probability = np.exp(np.fromiter(scores.values(), dtype=np.float64, count=len(scores)))
        self.unknown = math.exp(min(scores.values(), default=0.0) - 10.0)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are those of a piece's prefix, and the numbers of the pieces, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return known, np.where(known, self.numbers[at], -1)


def _next(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
    h = (h ^ letter) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def expected_uses(table: PieceTable, words: list[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations of the words (of one length) by their probability, times the words' counts."""
    n, length = len(words), len(words[0])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(n, length).astype(np.uint64)
    found: dict[tuple[int, int], np.ndarray] = {}
    for start in range(length):
        h, alive = np.zeros(n, dtype=np.uint64), np.arange(n)
        for end in range(start + 1, min(length, start + table.longest) + 1):
            h = _next(h, letters[alive, end - 1])
            known, number = table.find(h)
            if (number >= 0).any():
                found[start, end] = np.full(n, -1)
                found[start, end][alive] = number
            h, alive = h[known], alive[known]  # no piece goes on where none has this prefix
            if not len(alive):
                break
    chance = lambda start, end: np.where(found[start, end] >= 0, table.probability[found[start, end]], 0.0)
    unknown = [np.where(found[i, i + 1] >= 0, 0.0, table.unknown) if (i, i + 1) in found else np.full(n, table.unknown) for i in range(length)]
    # Scaled at each place, so that no product of many small numbers is lost.
    forward, backward, scale = np.zeros((length + 1, n)), np.zeros((length + 1, n)), np.ones((length + 1, n))
    forward[0] = 1.0
    for end in range(1, length + 1):
        total = forward[end - 1] * unknown[end - 1]
        step = np.ones(n)
        for start in range(end - 1, max(-1, end - table.longest - 1), -1):
            if start < end - 1:
                step = step * scale[start + 1]
            if (start, end) in found:
                total = total + forward[start] / step * chance(start, end)
        scale[end] = np.maximum(total, 1e-300)
        forward[end] = total / scale[end]
    backward[length] = 1.0
    for start in range(length - 1, -1, -1):
        total = backward[start + 1] * unknown[start] / scale[start + 1]
        step = np.ones(n)
        for end in range(start + 1, min(length, start + table.longest) + 1):
            step = step * scale[end]
            if (start, end) in found:
                total = total + backward[end] / step * chance(start, end)
        backward[start] = total
    uses = np.zeros(len(table.pieces))
    for (start, end), piece in found.items():
        step = np.prod(scale[start + 1 : end + 1], axis=0)
        share = forward[start] * chance(start, end) * backward[end] / step * counts
        np.add.at(uses, piece[piece >= 0], share[piece >= 0])
    return uses


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each word stands in all texts: word, n. Written; it grows with the vocabulary."""
    thin = df.select(F.col(text_col).cast("string").alias("text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        rows = lambda: pd.DataFrame({"word": [w.decode() for w in found], "n": list(found.values())})
        for batch in batches:
            for text in batch["text"]:
                for ws in word_lists(text):
                    found.update(ws)
                    if len(found) > MAX_COUNTED:
                        yield rows()
                        found.clear()
        if found:
            yield rows()

    return written(thin.mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def estimated_scores(df: DataFrame, initial: dict[str, float], text_col: str = "text", rounds: int = ROUNDS) -> dict[str, float]:
    """The pieces' log-probabilities by expectation maximisation over all words of the corpus."""
    counts = word_counts(df, text_col)
    scores = initial
    for _ in range(rounds):
        table = counts.sparkSession.sparkContext.broadcast(scores)

        def used(batches: Iterator[pd.DataFrame], table=table) -> Iterator[pd.DataFrame]:
            pieces = PieceTable(table.value)
            total = np.zeros(len(pieces.pieces))
            long: LongWords | None = None
            place: dict[str, int] = {}
            waiting: dict[int, tuple[list[str], list[float]]] = {}  # words by length, until there are enough to be taken at once
            for batch in batches:
                for w, n in zip(batch["word"].tolist(), batch["n"].tolist(), strict=True):
                    w = WORD_START + w
                    if len(w) > LONG:
                        long = long or LongWords(table.value)
                        place = place or {p: i for i, p in enumerate(pieces.pieces)}
                        for p, share in long.uses_of(w).items():
                            total[place[p]] += n * share
                        continue
                    words, counts = waiting.setdefault(len(w), ([], []))
                    words.append(w)
                    counts.append(n)
                    if len(words) == AT_ONCE:
                        total += expected_uses(pieces, words, np.array(counts, dtype=np.float64))
                        del waiting[len(w)]
            for words, counts in waiting.values():
                total += expected_uses(pieces, words, np.array(counts, dtype=np.float64))
            some = np.flatnonzero(total)
            if len(some):
                yield pd.DataFrame({"piece": [pieces.pieces[i] for i in some], "uses": total[some]})

        found = {r["piece"]: r["uses"] for r in counts.mapInPandas(used, "piece string, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}
        if not found:
            return scores
        norm = math.log(sum(found.values()) + PRIOR * len(initial))
        scores = {p: math.log(found.get(p, 0.0) + PRIOR) - norm for p in initial}
        table.destroy()
    return scores


class TerminalCounts(dict):
    """Word (UTF-8) to tokens."""

    def __init__(self, scores: dict[str, float], lot: int = LOT) -> None:
        super().__init__()
        self.trie, self.lot, self.scores, self.long = ForwardTrie(scores), lot, scores, None

    def learn(self, words: set[bytes]) -> None:
        """Take in words that have no count yet."""
        short: dict[str, bytes] = {}
        for w in words:
            marked = WORD_START + w.decode()
            if len(marked) <= LONG:
                short[marked] = w
            else:
                self.long = self.long or LongWords(self.scores)
                self[w] = self.long.tokens_of(marked)
        ordered = sorted(short)
        for lo in range(0, len(ordered), self.lot):
            part = ordered[lo : lo + self.lot]
            self.update(zip(map(short.__getitem__, part), self.trie.tokens_of(part).tolist(), strict=True))


def word_lists(text: str | None, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, in lists of about ``size`` bytes, so that a very long text is never split at once."""
    data = (text or "").encode()
    at = 0
    while at < len(data):
        to = at + size
        while to < len(data) and data[to] not in b"\t\n\v\f\r ":
            to += 1
        yield data[at:to].split()
        at = to


def token_counts(df: DataFrame, scores: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, lot: int = LOT, group: int = GROUP) -> DataFrame:
    """One row per input row: the id, n_words and n_tokens (long). Without ``scores`` they are estimated from ``df``."""
    vocabulary = df.sparkSession.sparkContext.broadcast(scores if scores is not None else estimated_scores(df, unigram_scores(), text_col))
    id_type = df.schema[id_col].dataType.simpleString()
    thin = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))  # pandas would round large ids beside nulls

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terminal = TerminalCounts(vocabulary.value, lot)
        for batch in batches:
            n_words, n_tokens = [0] * len(batch), [0] * len(batch)
            waiting: list[tuple[int, list[bytes]]] = []
            new: set[bytes] = set()

            def settle(waiting=waiting, new=new, n_tokens=n_tokens) -> None:
                terminal.learn(new)
                for i, ws in waiting:
                    n_tokens[i] += sum(map(terminal.__getitem__, ws))
                waiting.clear()
                new.clear()
                if len(terminal) > max_words:
                    terminal.clear()

            held = 0
            for i, text in enumerate(batch["text"]):
                for ws in word_lists(text):
                    n_words[i] += len(ws)
                    held += len(ws)
                    waiting.append((i, ws))
                    new.update(w for w in ws if w not in terminal)
                    if held > group:
                        settle()
                        held = 0
            settle()
            yield pd.DataFrame({"id": batch["id"], "n_words": n_words, "n_tokens": n_tokens})

    out = thin.mapInPandas(counted, "id string, n_words long, n_tokens long")
    return out.select(F.col("id").cast(id_type).alias(id_col), "n_words", "n_tokens")
