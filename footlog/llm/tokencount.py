"""Token counts under a unigram model, by dynamic programming shared over a trie of pre-tokens.

A text is cut into pre-tokens, which no piece of the vocabulary crosses. Distinct pre-tokens enter a trie whose nodes are
their prefixes. A node holds the best score of any segmentation of its prefix and that segmentation's number of tokens; it
is computed once, from the nodes above it, however many pre-tokens share it. A pre-token's count is that of its last node.
Ties go to the longer last piece. A character that no piece covers costs its UTF-8 bytes as tokens.

The trie lives in a Python worker and starts afresh when it is full, so memory is bounded; no result depends on that.

Nulls: a null or empty text has no tokens. Repeated rows give repeated result rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footlog.llm.common import BLOCK, Memo, row_slices

NODES, REMEMBERED = 500_000, 300_000
SPACE = "▁"
_loaded: dict[str, Counter] = {}


class Counter:
    """The pieces of one vocabulary with their scores, and the trie; one per Python worker."""

    def __init__(self, path: str, nodes: int = NODES) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.scores))
        self.tails = {p[i:] for p in self.scores for i in range(len(p))}
        self.unknown = min(self.scores.values()) - 10
        # Line breaks are in no piece here, so they separate pre-tokens as white space does.
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.scores))
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.nodes, self.most = {"": (0.0, 0)}, nodes
        self.memo = Memo(self.count, REMEMBERED)

    def count(self, word: str) -> int:
        """Tokens of a pre-token: extends the trie by the prefixes it lacks."""
        nodes, scores = self.nodes, self.scores
        if len(word) > self.longest * 64:
            return self._long(word)
        if len(nodes) > self.most:
            nodes.clear()
            nodes[""] = (0.0, 0)
        known = len(word)
        while word[:known] not in nodes:
            known -= 1
        states = {}
        for end in range(known + 1, len(word) + 1):
            nodes[word[:end]] = states[end] = self._best(word, end, states, nodes)
        return nodes[word][1]

    def _best(self, word: str, end: int, states: dict, nodes: dict) -> tuple[float, int]:
        """The state of a prefix from the states before it; ``states`` has those of this word met so far, ``nodes`` all."""
        scores, tails, best, tokens = self.scores, self.tails, None, 0
        for start in range(end - 1, -1, -1):
            part = word[start:end]
            if part not in tails:  # no piece ends with it
                break
            score = scores.get(part)
            if score is None:
                continue
            state = states.get(start)
            if state is None:
                state = states[start] = nodes[word[:start]]
            total = state[0] + score
            if best is None or total >= best:
                best, tokens = total, state[1] + 1
        last = word[end - 1]
        if last not in scores:
            state = states.get(end - 1) or nodes[word[: end - 1]]
            if best is None or state[0] + self.unknown > best:
                best, tokens = state[0] + self.unknown, state[1] + len(last.encode())
        return best, tokens

    def _long(self, word: str) -> int:
        """A very long pre-token, by a rolling window of the same states instead of trie nodes."""
        states = {0: (0.0, 0)}
        for end in range(1, len(word) + 1):
            states[end] = self._best(word, end, states, {})
            states.pop(end - self.longest, None)
        return states[len(word)][1]

    def text(self, text: str) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        if not text:
            return 0, 0
        spaced = SPACE + text.replace(" ", SPACE)
        if len(spaced) <= BLOCK:
            words = self.cut.findall(spaced)
            return len(words), sum(map(self.memo.__getitem__, words))
        total = tokens = 0
        for match in self.cut.finditer(spaced):
            total, tokens = total + 1, tokens + self.memo[match.group()]
        return total, tokens


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every whole text."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).text
        for batch in batches:
            for part in row_slices(batch, "text"):
                made = [count(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([m[i] for m in made], pa.int64()) for i in (0, 1))], names=["doc_id", "n_pretokens", "n_tokens"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
