"""Tokenisation, vocabularies and token sequences."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combisieve.functions.checks import require
from combisieve.functions.exprs import let
from combisieve.functions.grams import gram_counts, gram_minima, gram_words
from combisieve.functions.hashing import HASH_BITS
from combisieve.operators.ordering import row_index
from combisieve.operators.skew import attach_totals, broadcast_if_small, fits, scalar, spread_join
from combisieve.session import cut_lineage

# Special tokens in id order and the multi-character tokens of
# the character tokeniser.
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[MASK]", "[SEP]", "[BOS]", "[EOS]")
MULTI_CHAR = ("Br", "Cl", "@@", "[Dy]")
PAD, UNK, CLS, MASK = 0, 1, 2, 3
INLINE_TOKENS = 512


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text to tokens -----------------------------------------------------------

def apply_template(text: Column | str, template: str = "[CLS]{0}") -> Column:
    return F.replace(F.lit(template), F.lit("{0}"), _c(text))


def strip_marker(text: Column | str, marker: str = "[Dy]", to: str = "") -> Column:
    return F.replace(_c(text), F.lit(marker), F.lit(to))


def longest_pattern(units: Sequence[str]) -> str:
    """Listed units first (longest first), any single character otherwise."""
    by_length = sorted(units, key=lambda u: (-len(u), u))
    return "(?s)(" + "|".join([re.escape(u) for u in by_length] + ["."]) + ")"


def tokenize_longest(text: Column | str, units: Sequence[str] = SPECIALS + MULTI_CHAR) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(longest_pattern(units)), F.lit(1))


def tokenize_words(text: Column | str, specials: Sequence[str] = SPECIALS) -> Column:
    """Whitespace-separated words; a special token is always its own word."""
    apart = "(" + "|".join(re.escape(s) for s in specials) + ")"
    return F.regexp_extract_all(F.regexp_replace(_c(text), apart, " $1 "), F.lit(r"(?U)(\S+)"), F.lit(1))


# --- vocabularies ---------------------------------------------------------------

def token_counts(df: DataFrame, tokens: Column | str = "tokens", by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, F.explode(_c(tokens)).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))


def build_vocab(counts: DataFrame, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """``(token, id, n)``: specials first, then tokens by count, ties by text."""
    spark = counts.sparkSession
    counts = cut_lineage(counts)
    fixed = spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id bigint")
    plain = counts.filter(~F.col("token").isin(list(specials))).withColumn("__o", -F.col("n"))
    ranked = row_index(plain, ["__o", "token"], "id").select("token", (F.col("id") + len(specials)).alias("id"), "n")
    seen = fixed.join(counts, "token", "left").select("token", "id", F.coalesce("n", F.lit(0)).alias("n"))
    return seen.unionByName(ranked)


def map_elements(
    df: DataFrame, ids: Sequence[str], col: str, table: DataFrame, key: str, value: str, default: Column, out: str
) -> DataFrame:
    """``(ids, out)`` with every array element looked up in ``table``.

    Up to 512 entries become a map literal and no data moves; larger tables are
    joined on the exploded elements, which are put back in order.  Either way
    there is one row per row of ``df``, ids repeated or not; a NULL array stays
    NULL; NULL elements and unlisted ones become ``default``; of several entries
    of one key the lowest counts.
    """
    kind = table.schema[value].dataType
    table = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
    if fits(table, INLINE_TOKENS):
        pairs = [(r[0], r[1]) for r in table.select(key, value).collect()]
        lookup = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
        found = lambda x: F.coalesce(lookup[x], default) if pairs else default
        return df.select(*ids, F.transform(col, lambda x: found(x).cast(kind)).alias(out))
    cells = _cells(df, ids, col, key)
    right = table.select(key, F.col(value).alias("__v"))
    small = broadcast_if_small(right)
    if small is right:
        hit = spread_join(cells, right, [key], "left", [*ids, "__pos"])
    else:
        hit = cells.join(small, key, "left")
    # equal rows have equal cells: one set, and a row for each of them
    cell = F.when(F.col("__pos").isNotNull(), F.struct("__pos", F.coalesce("__v", default).cast(kind).alias("__v")))
    rows = _rows(hit, ids, F.array_sort(F.collect_set(cell)).alias("__c"))
    return rows.select(*ids, F.when(~F.col("__null"), F.col("__c.__v")).alias(out))


def _cells(df: DataFrame, ids: Sequence[str], col: str, key: str) -> DataFrame:
    """One row per element, with a hash of its array, as ids may repeat; a NULL
    or empty array has one row without an element."""
    return df.select(*ids, F.col(col).isNull().alias("__null"), F.xxhash64(col).alias("__mark"), F.posexplode_outer(col).alias("__pos", key))


def _rows(cells: DataFrame, ids: Sequence[str], agg: Column) -> DataFrame:
    """``agg`` of the cells of each row, as many times as the row was there."""
    copies = F.count_if(F.coalesce("__pos", F.lit(0)) == 0).alias("__copies")
    out = cells.groupBy(*ids, "__null", "__mark").agg(agg, copies)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))


def encode(df: DataFrame, vocab: DataFrame, ids: Sequence[str], tokens: str = "tokens", unk: int = UNK) -> DataFrame:
    return map_elements(df, ids, tokens, vocab, "token", "id", F.lit(unk), "input_ids")


def decode(df: DataFrame, vocab: DataFrame, ids: Sequence[str], input_ids: str = "input_ids", sep: str = "", skip: Sequence[int] = (PAD,)) -> DataFrame:
    """Ids back to text, leaving out ``skip`` ids."""
    kept = df.withColumn("__k", F.filter(input_ids, lambda x: ~x.isin(list(skip))))
    words = map_elements(kept, ids, "__k", vocab, "id", "token", F.lit("[UNK]"), "__t")
    return words.select(*ids, F.array_join("__t", sep).alias("text"))


def remap_ids(df: DataFrame, old: DataFrame, new: DataFrame, ids: Sequence[str], input_ids: str = "input_ids", missing: int = -999) -> DataFrame:
    """Ids of one vocabulary expressed in another, by token text."""
    right = new.select("token", F.col("id").alias("new_id"))
    table = old.select("token", F.col("id").alias("old_id")).join(right, "token", "left").select(
        "old_id", F.coalesce("new_id", F.lit(missing).cast("bigint")).alias("new_id")
    )
    return map_elements(df, ids, input_ids, table, "old_id", "new_id", F.lit(missing), "input_ids")


def encoding_mismatches(a: DataFrame, b: DataFrame, ids: Sequence[str], input_ids: str = "input_ids") -> DataFrame:
    """One row: rows compared, rows that differ, rows missing on either side."""
    left = a.select(*ids, F.col(input_ids).alias("__a"))
    right = b.select(*ids, F.col(input_ids).alias("__b"))
    both = left.join(right, list(ids), "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("__a") != F.col("__b")).alias("n_different"),
        F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("n_missing"),
    )


def count_unk(df: DataFrame, input_ids: str = "input_ids", unk: int = UNK) -> DataFrame:
    hits = F.size(F.filter(input_ids, lambda x: x == unk))
    return df.agg(F.count_if(hits > 0).alias("n_rows"), F.sum(hits).alias("n_unk"))


def assert_no_unk(df: DataFrame, input_ids: str = "input_ids", unk: int = UNK) -> DataFrame:
    """Passes rows through; fails on the first unknown token, whatever columns are
    read.  A NULL sequence or NULL token is not unknown."""
    found = F.coalesce(F.array_contains(input_ids, F.lit(unk).cast("bigint")), F.lit(False))
    return df.filter(require(~found, F.lit(True), "unknown token"))


def unseen_tokens(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test tokens that train lacks, with count and frequency rank in test."""
    ranked = row_index(test.withColumn("__o", -F.col("n")), ["__o", "token"], "rank").drop("__o")
    return ranked.join(train.select("token"), "token", "left_anti")


def rows_with_unseen(df: DataFrame, unseen: DataFrame, ids: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """``(ids, has_unseen)`` by token membership, one row per row of ``df``."""
    if fits(unseen, INLINE_TOKENS):
        # an empty list means no row has one
        values = [r[0] for r in unseen.filter("token is not null").select("token").collect()]
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(v) for v in values])) if values else F.lit(False)
        return df.select(*ids, F.coalesce(hit, F.lit(False)).alias("has_unseen"))
    cells = _cells(df.withColumn("__t", F.array_distinct(tokens)), ids, "__t", "token")
    known = unseen.filter("token is not null").select("token").distinct().withColumn("__u", F.lit(True))
    hit = spread_join(cells, known, ["token"], "left", [*ids, "__pos"])
    return _rows(hit, ids, F.max(F.coalesce("__u", F.lit(False))).alias("has_unseen")).select(*ids, "has_unseen")


def contains_any(text: Column | str, parts: Sequence[str]) -> Column:
    """Substring mode: the text contains one of the strings."""
    return _c(text).rlike("|".join(re.escape(p) for p in parts)) if parts else F.lit(False)


# --- sequences --------------------------------------------------------------------

def pad_fixed(seq: Column | str, length: int | Column, pad: int = PAD, truncate: bool = False) -> Column:
    """Right padding; a longer sequence is cut or, by default, an error."""
    c, n = _c(seq), F.lit(length) if isinstance(length, int) else length
    fill = F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(n - F.size(c), F.lit(0)))
    filled = F.concat(F.slice(c, F.lit(1), n), fill)
    return filled if truncate else require(F.size(c) <= n, filled, "sequence longer than the fixed length")


def pad_batch(
    df: DataFrame, batch: str, ids: Sequence[str], seq: str | Mapping[str, object], max_len: int, pad: int = PAD, padding: bool = True
) -> DataFrame:
    """Pad to the longest sequence of the batch (or cut to its shortest),
    never beyond ``max_len``.

    Several sequences come as ``{column: its pad value}``: arrays of any element
    type that have one length per row, which the first of them tells.
    """
    pads = {seq: pad} if isinstance(seq, str) else dict(seq)
    own = F.size(next(iter(pads)))
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("__n"), (F.max(own) if padding else F.min(own)).alias("__len"))
    out = attach_totals(df, sizes, [batch], "__n", ids)
    target = F.least(F.col("__len"), F.lit(max_len))
    return out.withColumns({c: _filled(F.col(c), target, F.lit(value).cast(df.schema[c].dataType.elementType)) for c, value in pads.items()}).drop("__n", "__len")


def _filled(c: Column, n: Column, pad: Column) -> Column:
    return F.concat(F.slice(c, F.lit(1), n), F.array_repeat(pad, F.greatest(n - F.size(c), F.lit(0))))


def used_length(seq: Column | str, pad: int = PAD) -> Column:
    """Position after the last element that is not padding."""
    return F.coalesce(F.array_max(F.transform(_c(seq), lambda x, i: F.when(x != pad, i + 1).otherwise(F.lit(0)))), F.lit(0))


def trim_padding(df: DataFrame, seq: str, pad: int = PAD) -> DataFrame:
    """Drop trailing positions that are padding in every row."""
    longest = scalar(df, F.max(used_length(seq, pad)))
    return df.withColumn(seq, F.slice(seq, F.lit(1), longest))


def padding_mask(seq: Column | str, pad: int = PAD) -> Column:
    return F.transform(_c(seq), lambda x: x != pad)


def true_length(seq: Column | str, pad: int = PAD) -> Column:
    return F.size(F.filter(_c(seq), lambda x: x != pad))


def special_mask(seq: Column | str, specials: Sequence[int] = tuple(range(len(SPECIALS)))) -> Column:
    return F.transform(_c(seq), lambda x: x.isin(list(specials)))


def mlm_mask(
    df: DataFrame,
    ids: Sequence[str],
    vocab_size: int,
    seq: str = "input_ids",
    p: float = 0.15,
    mask_prob: float = 0.8,
    random_prob: float = 0.1,
    mask_id: int = MASK,
    specials: Sequence[int] = tuple(range(len(SPECIALS))),
    seed: object = 42,
) -> DataFrame:
    """Masked-token inputs and labels (-1 where nothing is to be predicted).

    One md5 per position supplies three independent 32-bit draws: whether the
    token is picked, what happens to it, and the random replacement.
    """
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids])

    full = float(2**32)
    redraw = random_prob / (1.0 - mask_prob)

    def below(h: Column, at: int, limit: float) -> Column:
        """Whether the draw is below a limit: eight hex digits order like their number."""
        top = math.ceil(limit)
        return F.lit(True) if top >= 2**32 else F.substring(h, at, 8) < F.lit(f"{max(0, top):08x}")

    def one(x: Column, h: Column) -> Column:
        picked = below(h, 1, full * p) & ~x.isin(list(specials))
        drawn = F.conv(F.substring(h, 17, 8), 16, 10).cast("bigint")
        new = F.when(below(h, 9, full * mask_prob), F.lit(mask_id).cast("bigint")).when(
            below(h, 9, full * (mask_prob + (1.0 - mask_prob) * redraw)), drawn % vocab_size
        ).otherwise(x)
        return F.struct(F.when(picked, new).otherwise(x).alias("i"), F.when(picked, x).otherwise(F.lit(-1).cast("bigint")).alias("l"))

    # key and md5 are bound: an expression inside a lambda is evaluated at each place it stands
    place = lambda k: lambda x, i: let(F.md5(F.concat_ws(":", k, i.cast("string"))), lambda h: one(x, h))
    out = df.withColumn("__m", let(key, lambda k: F.transform(seq, place(k))))
    return out.withColumns({seq: F.col("__m.i"), "labels": F.col("__m.l")}).drop("__m")


def drop_token_ids(seq: Column | str, ids: Sequence[int], pad: int = PAD) -> Column:
    """Remove listed ids, shift left, keep the width."""
    c = _c(seq)
    return pad_fixed(F.filter(c, lambda x: ~x.isin(list(ids))), F.size(c), pad, truncate=True)


def multi_hot(seq: Column | str, vocab_size: int) -> Column:
    """0/1 per vocabulary id, without the padding column 0: the present ids in
    order, each behind the zeros since the one before."""
    zeros = lambda n: F.array_repeat(F.lit(0), n.cast("int"))
    inside = F.array_sort(F.array_distinct(F.filter(_c(seq), lambda x: (x > 0) & (x < vocab_size))))

    def cells(ids: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ids, i - 1)).otherwise(F.lit(0))
        runs = F.transform(ids, lambda x, i: F.concat(zeros(x - before(i) - 1), F.array(F.lit(1))))
        last = F.coalesce(F.get(ids, F.size(ids) - 1), F.lit(0))
        return F.concat(F.flatten(runs), zeros(F.lit(vocab_size - 1) - last))

    return let(inside, cells)


def present_ids(seq: Column | str, pad: int = PAD) -> Column:
    """Sparse form of :func:`multi_hot`."""
    return F.array_sort(F.filter(F.array_distinct(_c(seq)), lambda x: x != pad))


def characters(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), ""), lambda x: x != "")


def char_index(df: DataFrame, text: str, alphabet: DataFrame, width: Column, ids: Sequence[str]) -> DataFrame:
    """``(ids, char_ids)``: id per character from ``(token, id)``, zero padded
    to ``width`` (the longest text of all tables)."""
    chars = df.select(*ids, characters(text).alias("__chars"))
    mapped = map_elements(chars, ids, "__chars", alphabet, "token", "id", F.lit(0), "char_ids")
    return mapped.withColumn("char_ids", pad_fixed("char_ids", width, 0))


def longest_text(*columns: tuple[DataFrame, str]) -> Column:
    """Character length of the longest text over several tables."""
    return F.greatest(*[scalar(df, F.max(F.char_length(c))) for df, c in columns], F.lit(0))


# --- hashed text features -----------------------------------------------------------

def qgrams(text: Column | str, q: int) -> Column:
    """Overlapping character q-grams of the whole text, in one pass: a q-gram is
    seen from each character, which is consumed.  A NULL text has none."""
    found = F.regexp_extract_all(_c(text), F.lit(f"(?s)(?=(.{{{q}}}))."), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def qgram_fingerprint(df: DataFrame, ids: Sequence[str], text: str, q: int = 4, n_bits: int = 1024, counts: bool = False) -> DataFrame:
    """``(ids, words)`` 32-bit words of the hashed q-gram set, or ``(ids,
    cells)`` sorted ``(bit, n)`` counts."""
    shift = HASH_BITS - (n_bits - 1).bit_length()
    if not counts:
        return df.select(*ids, gram_words(_c(text), q, n_bits, shift).alias("words"))

    def cells(rows: DataFrame) -> DataFrame:
        return rows.select(*ids, F.inline(gram_counts(_c(text), q, n_bits, shift)))

    def together(rows: DataFrame) -> DataFrame:
        return cells(rows).groupBy(*ids, "bit").agg(F.sum("n").alias("n"))

    # only rows whose ids come again have cells to add up
    again = df.groupBy(*[F.col(c).alias(f"__k_{c}") for c in ids]).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    if again.isEmpty():
        return cells(df)
    if not fits(again):
        return together(df)
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in ids]
    one, more = (df.join(F.broadcast(again), same, how) for how in ("left_anti", "left_semi"))
    return cells(one).unionByName(together(more))


def bits_to_words(bits: Column, n_bits: int) -> Column:
    """Set positions (distinct, below ``n_bits``) as 32-bit words, position p in
    word p/32: one fold over the sorted positions, which closes a word when the
    next one begins."""
    zero = F.lit(0).cast("bigint")
    zeros = lambda n: F.array_repeat(zero, n.cast("int"))
    start = F.struct(F.array().cast("array<bigint>").alias("done"), zero.alias("at"), zero.alias("open"))

    def step(acc: Column, b: Column) -> Column:
        word, bit = F.floor(b / 32).cast("bigint"), F.pow(F.lit(2.0), b % 32).cast("bigint")
        closed = F.concat(acc["done"], F.array(acc["open"]), zeros(word - acc["at"] - 1))
        same = word == acc["at"]
        return F.struct(
            F.when(same, acc["done"]).otherwise(closed).alias("done"), word.alias("at"), F.when(same, acc["open"] + bit).otherwise(bit).alias("open")
        )

    n_words = (n_bits + 31) // 32
    return F.aggregate(
        F.array_sort(bits), start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"]), zeros(F.lit(n_words - 1) - acc["at"]))
    )


# Fixed value: a Mersenne prime for the linear hash family.
MERSENNE = 2**31 - 1


def minhash_signature(text: Column | str, q: int = 4, n_hashes: int = 64, seed: int = 42) -> Column:
    """Minimum per linear hash ``(a*h + b) mod p`` over the q-gram hashes; an
    empty q-gram set gives ``p`` everywhere.  One md5 per q-gram."""
    return gram_minima(_c(text), q, HASH_BITS - 31, MERSENNE, hash_family(n_hashes, seed))


def hash_family(n: int, seed: int) -> list[tuple[int, int]]:
    """Seeded multipliers (non-zero) and offsets."""
    def number(i: int, part: str) -> int:
        return int(hashlib.md5(f"{seed}:{part}:{i}".encode()).hexdigest()[:13], 16) % MERSENNE

    return [(number(i, "a") or 1, number(i, "b")) for i in range(n)]
