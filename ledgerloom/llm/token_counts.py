"""Token counts of a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A text's words (between ASCII white space), each behind the mark U+2581, are its pre-tokens. Arrow
numbers the distinct ones of a batch; the new ones are inserted in a trie (kept as sorted words and
the length of the prefix each shares with the one before it). A walk over the trie computes the
forward score once per node, that is once per shared prefix: the best score of any segmentation of
the prefix, and the number of pieces it takes. A node also keeps where a piece may still be under
way, so its children try only these. Where a pre-token ends, its count is stored.

Scores follow from the vocabulary file: a piece of rank r has the log probability of a Zipf law,
-ln(r + 3); a character in no piece is taken byte by byte at BYTE_SCORE each. Of equal scores,
fewer pieces win.

Defined results: null and blank texts have no tokens; a word of any length is one pre-token; other
columns stay, and where one has the name of the new column, that gets underscores in front; rows
are counted one by one, whatever repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import fresh, table

MARK = "▁"
BYTE_SCORE = -14.0
CACHE_WORDS = 400_000
COUNTS = T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@cache
def piece_scores(path: str) -> dict[str, float]:
    """Log probability by piece; control, unknown and byte pieces have none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {piece: -math.log(rank + 3) for rank, piece in enumerate(usual)}


@cache
def piece_prefixes(path: str) -> dict[str, float | None]:
    """Every prefix of every piece, with the score of those that are pieces."""
    scores = piece_scores(path)
    return dict.fromkeys(piece[:n] for piece in scores for n in range(1, len(piece))) | scores


def trie_counts(pretokens: Iterable[str], prefixes: dict[str, float | None]) -> dict[str, int]:
    """Pieces of the best segmentation of each pre-token.

    best[i], pieces[i] and begun[i] belong to the trie node that the first i characters lead to;
    begun lists the places from which a piece may reach beyond it. Sorted pre-tokens visit the
    trie depth first, so the nodes of the prefix shared with the one before are still there.
    """
    best, pieces, begun, out, last = [0.0], [0], [[0]], {}, ""
    for word in sorted(set(pretokens)):
        shared, most = 0, min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        del best[shared + 1 :], pieces[shared + 1 :], begun[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "replace"))
            score, n, reach = best[end - 1] + size * BYTE_SCORE, pieces[end - 1] + size, []
            for start in begun[end - 1]:
                found = prefixes.get(word[start:end], False)
                if found is False:
                    continue
                reach.append(start)
                if found is not None:
                    total = best[start] + found
                    if total > score or total == score and pieces[start] + 1 < n:
                        score, n = total, pieces[start] + 1
            reach.append(end)
            best.append(score)
            pieces.append(n)
            begun.append(reach)
        out[word], last = pieces[len(word)], word
    return out


@cache
def known_counts(path: str) -> dict[str, int]:
    """Counts by pre-token that this Python worker remembers, CACHE_WORDS at most, shared by its tasks."""
    return {}


def counts_of(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pre-tokens and of tokens of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.dictionary_encode(split.flatten())
    words, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), known_counts(path)
    new = [w for w in words if w and w not in known]
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()
        new = [w for w in words if w]
    known.update((w[1:], n) for w, n in trie_counts((MARK + w for w in new), piece_prefixes(path)).items())
    each = np.array([known[w] if w else 0 for w in words] or [0], np.int64)
    filled = np.array([w != "" for w in words] or [False], np.int64)
    at, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    return tuple(np.diff(np.concatenate([[0], np.cumsum(x[at])])[bounds - bounds[0]]) for x in (filled, each))


def with_token_counts(df: DataFrame, text: str = "text", counts: str = "counts", path: str | None = None) -> DataFrame:
    """df with a struct of n_pretokens and n_tokens."""
    found = path or vocabulary_path()
    (name,) = fresh(df, counts)

    @F.arrow_udf(COUNTS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.StructArray.from_arrays([pa.array(x) for x in counts_of(texts, found)], names=COUNTS.names)

    return df.withColumn(name, run(F.col(text)))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_pretokens, n_tokens."""
    counted = with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "counts.n_pretokens", "counts.n_tokens")
