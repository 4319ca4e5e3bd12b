"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: ranked merges folded by Spark's higher-order functions.  A text is split into
words by the tokenizer's pattern; a word is an array of byte pieces; ``aggregate`` merges
the neighbours of lowest rank until none is left.  The rank map is a literal of the plan:
an array of small maps, indexed by a checksum, so that a lookup is one index step and a
few comparisons.

Distinct words are encoded once.  The ``HOT`` most frequent of them become a second
literal of the same form (a bounded number of words, whatever the corpus holds); a word
that isn't among them is folded where it occurs, a very long one block by block.  So there is no join and no shuffle of
tokens, and no word is left out.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickstream.llm.skeleton import let

HOT = 65_536
SHARDS = 8_192
NONE = 2**31 - 1
LONG = 512  # bytes from which a word is encoded in blocks, as a single fold takes time that grows as the square
BLOCK = 256
# Fixed value: how this tokenizer's vocabulary splits text into words.
PATTERN = "(?U)'(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
DEFAULT = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = DEFAULT) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[str, int]:
    """Hexadecimal bytes of each token and its rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token).hex(): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def longest_piece(ranks: dict[str, int]) -> int:
    """Bytes of the longest token."""
    return max(map(len, ranks)) // 2


def sharded(entries: dict[str, object], value_type: str) -> Column:
    """Literal lookup table: an array of maps, indexed by the checksum of the key."""
    shards: list[dict[str, object]] = [{} for _ in range(SHARDS)]
    for key, value in entries.items():
        shards[zlib.crc32(key.encode()) % SHARDS][key] = value
    # folded to one literal when the plan is optimised
    return F.from_json(F.lit(json.dumps(shards, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{value_type}>>")


def look_up(table: Column, key: Column) -> Column:
    return F.element_at(F.get(table, (F.crc32(key) % SHARDS).cast("int")), key)


def _fold(word_hex: Column, ranks: Column) -> Column:
    """Ids of one word (its UTF-8 bytes in hexadecimal, at least one) by ranked merges."""
    rank = lambda piece: F.coalesce(look_up(ranks, piece), F.lit(NONE))

    def merge(state: Column, low: Column) -> Column:
        p, r = state["p"], state["r"]
        at = F.array_position(r, low).cast("int")

        def at_position(i: Column) -> Column:
            joined = F.concat(F.get(p, i - 1), F.get(p, i))
            empty = F.array().cast("array<int>")

            def with_piece(new: Column) -> Column:
                before = F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), new)))).otherwise(empty)
                after = F.when(i + 1 < F.size(p), F.array(rank(F.concat(new, F.get(p, i + 1))))).otherwise(empty)
                return F.struct(
                    F.concat(F.slice(p, 1, i - 1), F.array(new), F.slice(p, i + 2, F.size(p))).alias("p"),
                    F.concat(F.slice(r, 1, F.greatest(i - 2, F.lit(0))), before, after, F.slice(r, i + 2, F.size(p))).alias("r"),
                )

            return let(joined, with_piece)

        return let(at, at_position)

    def step(state: Column, _: Column) -> Column:
        return let(F.coalesce(F.array_min(state["r"]), F.lit(NONE)), lambda low: F.when(low == NONE, state).otherwise(merge(state, low)))

    def folded(pieces: Column) -> Column:
        n = F.size(pieces)
        pairs = F.zip_with(F.slice(pieces, 1, n - 1), F.slice(pieces, 2, n), lambda a, b: rank(F.concat(a, b)))
        start = F.struct(pieces.alias("p"), pairs.alias("r"))
        steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda s: F.transform(s["p"], lambda x: look_up(ranks, x)))

    whole = look_up(ranks, word_hex)
    bytes_ = F.regexp_extract_all(word_hex, F.lit("(..)"), F.lit(1))
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(let(bytes_, folded))


def _stream(word_hex: Column, ranks: Column, longest: int) -> Column:
    """Ids of a long word in time that grows as its length.

    The last token of every beginning of the word is the one vocabulary piece that ends
    there and stays apart from the last token before it when the two are merged by
    themselves; a sequence whose neighbours all stay apart is what the ranked merges give.
    So the beginnings are taken from left to right, in blocks that carry the last tokens
    of ``longest`` bytes on, and the tokens are read off from the right.
    """
    n = (F.length(word_hex) / 2).cast("int")
    blocks = F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int"))
    text = F.array().cast("array<string>")
    size = lambda piece: (F.length(piece) / 2).cast("int")

    def apart(before: Column, piece: Column) -> Column:
        return _fold(F.concat(before, piece), ranks) == F.array(look_up(ranks, before), look_up(ranks, piece))

    def forward(state: Column, b: Column) -> Column:
        begin = b * BLOCK  # bytes before the block
        kept = F.size(state["carry"])  # last tokens of the beginnings begin - kept + 1 to begin

        def in_block(part: Column) -> Column:
            def step(last: Column, i: Column) -> Column:
                # i bytes of ``part`` after its first ``kept`` are taken
                window = F.substring(part, F.greatest((kept + i - longest) * 2 + 1, F.lit(1)), F.least(kept + i, F.lit(longest)) * 2)

                def choose(w: Column) -> Column:
                    lengths = F.filter(F.sequence(size(w), F.lit(1), F.lit(-1)), lambda k: look_up(ranks, F.right(w, k * 2)).isNotNull())

                    def attempt(done: Column, k: Column) -> Column:
                        piece, before = F.right(w, k * 2), F.get(last, F.size(last) - k)
                        fits = (begin + i == k) | (before.isNotNull() & apart(before, piece))
                        return F.when(done.isNotNull(), done).when(fits, piece)

                    return F.aggregate(lengths, F.lit(None).cast("string"), attempt)

                return F.concat(last, F.array(let(window, choose)))

            steps = F.sequence(F.lit(1), F.least(F.lit(BLOCK), n - begin))
            return F.aggregate(steps, state["carry"], step)

        def next_state(last: Column) -> Column:
            carried = F.slice(last, F.greatest(F.size(last) - longest + 1, F.lit(1)), F.lit(longest))
            return F.struct(carried.alias("carry"), F.concat(state["out"], F.array(F.slice(last, kept + 1, F.greatest(F.size(last) - kept, F.lit(0))))).alias("out"))

        part = F.substring(word_hex, (begin - kept) * 2 + 1, (kept + BLOCK) * 2)
        return let(let(part, in_block), next_state)

    start = F.struct(text.alias("carry"), F.array().cast("array<array<string>>").alias("out"))

    def backward(lasts: Column) -> Column:
        def block(state: Column, b: Column) -> Column:
            own = F.get(lasts, b)

            def step(s: Column, i: Column) -> Column:
                piece = F.get(own, i - 1)
                hit = s["at"] == b * BLOCK + i
                return F.when(hit, F.struct((s["at"] - size(piece)).alias("at"), F.concat(F.array(piece), s["out"]).alias("out"))).otherwise(s)

            inner = F.aggregate(F.sequence(F.size(own), F.lit(1), F.lit(-1)), F.struct(state["at"].alias("at"), text.alias("out")), step)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(F.array(x["out"]), state["out"]).alias("out")))

        whole = F.aggregate(F.reverse(blocks), F.struct(n.alias("at"), F.array().cast("array<array<string>>").alias("out")), block, lambda x: F.flatten(x["out"]))
        return F.transform(whole, lambda x: look_up(ranks, x))

    return let(F.aggregate(blocks, start, forward, lambda x: x["out"]), backward)


def _encode(word_hex: Column, ranks: Column, longest: int) -> Column:
    """Ids of one word: long ones in blocks, others by one fold; both give the same."""
    return F.when(F.length(word_hex) > LONG * 2, _stream(word_hex, ranks, longest)).otherwise(_fold(word_hex, ranks))


def words(text: Column) -> Column:
    """Words of a text by the tokenizer's pattern; null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1)), F.array().cast("array<string>"))


def _hex(word: Column) -> Column:
    return F.lower(F.hex(F.encode(word, "UTF-8")))


def word_ids(distinct: DataFrame, word: str, ranks: dict[str, int]) -> DataFrame:
    """``word, ids`` of each row of a table of words."""
    table = sharded(ranks, "int")
    return distinct.select(word, let(table, lambda t: _encode(_hex(F.col(word)), t, longest_piece(ranks))).alias("ids"))


def hot_words(documents: DataFrame, text: str, hot: int = HOT) -> DataFrame:
    """The ``hot`` most frequent words of all texts (ties by the word)."""
    counts = documents.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(hot).select("word")


def encoder(documents: DataFrame, text: str, path: str | None = None, hot: int = HOT) -> Callable[[Column], Column]:
    """Column function that gives the ids of a text, prepared for the words of ``documents``.

    Runs one job over all texts for the hot words; at most ``hot`` words come to the driver.
    """
    ranks = read_ranks(path or tokenizer_path())
    parts = documents.sparkSession.sparkContext.defaultParallelism * 2
    known = word_ids(hot_words(documents, text, hot).repartition(parts, "word"), "word", ranks).toPandas()
    table, memo = sharded(ranks, "int"), sharded(dict(zip(known["word"], [list(map(int, x)) for x in known["ids"]], strict=True)), "array<int>")

    def ids(value: Column) -> Column:
        each = lambda t, m: F.flatten(F.transform(words(value), lambda w: F.coalesce(look_up(m, w), _encode(_hex(w), t, longest_piece(ranks)))))
        return let(table, lambda t: let(memo, lambda m: each(t, m)))

    return ids


def encoded(documents: DataFrame, row_id: str, text: str, path: str | None = None, hot: int = HOT) -> DataFrame:
    """``row_id, ids``: the token ids of each text; null and empty texts give an empty list.

    One row for each row of ``documents``, repeated ids included; texts of any length are
    encoded whole.
    """
    ids = encoder(documents, text, path, hot)
    return documents.select(F.col(row_id), ids(F.col(text)).alias("ids"))


def decoded(rows: DataFrame, ids: str, path: str | None = None) -> Column:
    """Text of a column of ids: the concatenated bytes of their tokens."""
    ranks = read_ranks(path or tokenizer_path())
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    table = F.split(F.lit(",".join(pieces)), ",")
    return let(table, lambda t: F.decode(F.unhex(F.array_join(F.transform(F.col(ids), lambda i: F.get(t, i)), "")), "UTF-8"))
