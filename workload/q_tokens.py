"""Tokens and vocabularies."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from combisieve.operators import tokens as T
from workload import fixtures as X
from workload.base import joined, query


PATTERN = T.longest_pattern(T.SPECIALS + T.MULTI_CHAR)
D_MOL = f"mol as (select mol_id, bb1, scaffold, molecule, regexp_extract_all(molecule, '{PATTERN}', 1) tokens from lib)"
_APART = "(" + "|".join(re.escape(s) for s in T.SPECIALS) + ")"
D_WORDS = f"words as (select doc_id, lang, source, regexp_extract_all(regexp_replace(text, '{_APART}', ' \\1 ', 'g'), '(\\S+)', 1) tokens from documents)"


def d_vocab(src: str, name: str = "vocab") -> str:
    fixed = ", ".join(f"('{t}',{i})" for i, t in enumerate(T.SPECIALS))
    return f"""cnt_{name} as (select token, count(*) n from (select unnest(tokens) token from {src}) group by 1),
{name} as (select token, id::bigint id, coalesce(n,0)::bigint n from (values {fixed}) s(token,id) left join cnt_{name} using (token) union all
 select token, row_number() over (order by n desc, token)+6, n from cnt_{name} where token not in ({', '.join(f"'{t}'" for t in T.SPECIALS)}))"""


def d_encode(src: str, key: str, vocab: str = "vocab", name: str = "enc") -> str:
    return f"""{name} as (select {key}, list(coalesce(id,1) order by pos) as input_ids from
 (select {key}, unnest(tokens) token, generate_subscripts(tokens,1) pos from {src}) left join {vocab} using (token) group by 1)"""


def _mol(spark, sf):
    return X.lib(spark, sf).select("mol_id", "bb1", "scaffold", "molecule").withColumn("tokens", T.tokenize_longest("molecule"))


def _words(spark, sf):
    return X.table(spark, sf, "documents").withColumn("tokens", T.tokenize_words("text"))


def _mol_vocab(spark, sf):
    return T.build_vocab(T.token_counts(_mol(spark, sf)))


def _mol_ids(spark, sf, *keep):
    enc = T.encode(_mol(spark, sf), _mol_vocab(spark, sf), ["mol_id", *keep])
    return enc


MOL = [X.D_LIB, D_MOL, d_vocab("mol"), d_encode("mol", "mol_id")]


def text(c: str, alias: str | None = None) -> str:
    return f"array_to_string({c}, ',') as {alias or c}"


@query("tk1_apply_template", X.sql(X.D_LIB, body="select mol_id, '[CLS]'||molecule as text from lib"))
def apply_template(spark, sf):
    return X.lib(spark, sf).select("mol_id", T.apply_template("molecule").alias("text"))


@query("tk2_strip_marker", X.sql(X.D_LIB, body="select mol_id, replace(molecule,'[Dy]','') as text, replace(molecule,'[Dy]','C') as replaced from lib"))
def strip_marker(spark, sf):
    return X.lib(spark, sf).select(
        "mol_id", T.strip_marker("molecule").alias("text"), T.strip_marker("molecule", to="C").alias("replaced")
    )


@query("tk3_tokenize_longest", X.sql(X.D_LIB, D_MOL, body=f"select mol_id, {text('tokens')} from mol"))
def tokenize_longest(spark, sf):
    return _mol(spark, sf).select("mol_id", joined("tokens").alias("tokens"))


@query("tk4_tokenize_words", X.sql(D_WORDS, body=f"select doc_id, len(tokens)::int as n, {text('tokens')} from words"))
def tokenize_words(spark, sf):
    return _words(spark, sf).select("doc_id", F.size("tokens").alias("n"), joined("tokens").alias("tokens"))


@query("tk5_token_counts", X.sql(D_WORDS, body="select lang, token, count(*) as n from (select lang, unnest(tokens) token from words) group by all"))
def token_counts(spark, sf):
    return T.token_counts(_words(spark, sf), by=["lang"])


@query("tk6_build_vocab", X.sql(D_WORDS, d_vocab("words"), body="select * from vocab"))
def build_vocab(spark, sf):
    return T.build_vocab(T.token_counts(_words(spark, sf)))


@query("tk7_encode", X.sql(*MOL, body=f"select mol_id, {text('input_ids')} from enc"))
def encode(spark, sf):
    return _mol_ids(spark, sf).select("mol_id", joined("input_ids").alias("input_ids"))


@query("tk7_encode_large_vocab", X.sql(D_WORDS, "en as (select * from words where lang='en')", d_vocab("en"), d_encode("words", "doc_id"), body=f"""
select doc_id, coalesce(array_to_string(input_ids, ','), '') as input_ids from documents left join enc using (doc_id)"""))
def encode_large_vocab(spark, sf):
    words = _words(spark, sf)
    vocab = T.build_vocab(T.token_counts(words.filter("lang = 'en'")))
    return T.encode(words, vocab, ["doc_id"]).select("doc_id", joined("input_ids").alias("input_ids"))


_PADDED = "pad as (select mol_id, list_concat(input_ids, list_transform(range(0, {n}-len(input_ids)), lambda x: 0::bigint)) as input_ids from enc)"


def _padded(spark, sf, n=96):
    return _mol_ids(spark, sf).withColumn("input_ids", T.pad_fixed("input_ids", n))


@query("tk8_pad_fixed", X.sql(*MOL, _PADDED.format(n=96), body=f"select mol_id, {text('input_ids')} from pad"))
def pad_fixed(spark, sf):
    return _padded(spark, sf).select("mol_id", joined("input_ids").alias("input_ids"))


@query("tk9_pad_batch", X.sql(*MOL, """
b as (select mol_id, input_ids, max(len(input_ids)) over (partition by scaffold) n from enc join lib using (mol_id))""", body=f"""
select mol_id, array_to_string(list_concat(input_ids, list_transform(range(0, n-len(input_ids)), lambda x: 0::bigint)), ',') as input_ids from b"""))
def pad_batch(spark, sf):
    enc = _mol_ids(spark, sf, "scaffold")
    return T.pad_batch(enc, "scaffold", ["mol_id"], "input_ids", 4096).select("mol_id", joined("input_ids").alias("input_ids"))


@query("tk9_pad_batch_two", X.sql(*MOL, """
b as (select mol_id, input_ids, least(max(len(input_ids)) over (partition by scaffold), 40) n from enc join lib using (mol_id))""", body=f"""
select mol_id, array_to_string(list_concat(input_ids[1:n], list_transform(range(0, n-len(input_ids)), lambda x: 7::bigint)), ',') as input_ids,
 array_to_string(list_concat(list_transform(input_ids[1:n], lambda x: x%2=0), list_transform(range(0, n-len(input_ids)), lambda x: true)), ',') as even from b"""))
def pad_batch_two(spark, sf):
    """Ids and a mask of one length per row, each with its own padding."""
    enc = _mol_ids(spark, sf, "scaffold").withColumn("even", F.transform("input_ids", lambda x: x % 2 == 0))
    out = T.pad_batch(enc, "scaffold", ["mol_id"], {"input_ids": 7, "even": True}, 40)
    return out.select("mol_id", joined("input_ids").alias("input_ids"), joined("even").alias("even"))


@query("tk10_trim_padding", X.sql(*MOL, "m as (select max(len(input_ids)) n from enc)", body="""
select mol_id, n::int as width, array_to_string(list_concat(input_ids, list_transform(range(0, n-len(input_ids)), lambda x: 0::bigint)), ',') as input_ids from enc, m"""))
def trim_padding(spark, sf):
    out = T.trim_padding(_padded(spark, sf), "input_ids")
    return out.select("mol_id", F.size("input_ids").alias("width"), joined("input_ids").alias("input_ids"))


@query("tk11_padding_mask", X.sql(*MOL, _PADDED.format(n=96), body="""
select mol_id, array_to_string(list_transform(input_ids, lambda x: x<>0), ',') as padding_mask,
 len(list_filter(input_ids, lambda x: x<>0))::int as length from pad"""))
def padding_mask(spark, sf):
    df = _padded(spark, sf).withColumn("padding_mask", T.padding_mask("input_ids"))
    return df.select("mol_id", joined("padding_mask").alias("padding_mask"), T.true_length("input_ids").alias("length"))


@query("tk12_decode", X.sql(X.D_LIB, body="select mol_id, molecule as text, true as same from lib"))
def decode(spark, sf):
    back = T.decode(_padded(spark, sf), _mol_vocab(spark, sf), ["mol_id"])
    lib = X.lib(spark, sf).select("mol_id", "molecule")
    return back.join(lib, "mol_id").select("mol_id", "text", (F.col("text") == F.col("molecule")).alias("same"))


@query("tk13_special_mask", X.sql(*MOL, _PADDED.format(n=96), body="""
select mol_id, array_to_string(list_transform(input_ids, lambda x: x<7), ',') as mask from pad"""))
def special_mask(spark, sf):
    df = _padded(spark, sf).withColumn("mask", T.special_mask("input_ids"))
    return df.select("mol_id", joined("mask").alias("mask"))


def _d_draw(at: int) -> str:
    return f"('0x'||substr(md5('42:'||mol_id::varchar||':'||(pos-1)::varchar),{at},8))::bigint"


@query("tk14_mlm_mask", X.sql(*MOL, "v as (select count(*) n from vocab)", f"""
d as (select mol_id, pos, x, n, x>=7 and {_d_draw(1)}<0.15::double*4294967296 as hit, {_d_draw(9)} a, {_d_draw(17)} w from
 (select mol_id, unnest(input_ids) x, generate_subscripts(input_ids,1) pos from enc), v)""", body="""
select mol_id, array_to_string(list(case when not hit then x when a<0.8::double*4294967296 then 3
 when a<(0.8::double+(1-0.8::double)*(0.1::double/(1-0.8::double)))*4294967296 then w%n else x end order by pos), ',') as input_ids,
 array_to_string(list(case when hit then x else -1 end order by pos), ',') as labels from d group by mol_id"""))
def mlm_mask(spark, sf):
    n = _mol_vocab(spark, sf).count()
    out = T.mlm_mask(_mol_ids(spark, sf), ["mol_id"], n)
    return out.select("mol_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


_UNSEEN = [
    D_WORDS,
    "tr as (select token, count(*) n from (select unnest(tokens) token from words where lang='en') group by 1)",
    "te as (select token, count(*) n from (select unnest(tokens) token from words where lang<>'en') group by 1)",
    "unseen as (select * from (select token, n, row_number() over (order by n desc, token)-1 as rank from te) where token not in (select token from tr))",
]


def _unseen(spark, sf):
    words = _words(spark, sf)
    return T.unseen_tokens(T.token_counts(words.filter("lang = 'en'")), T.token_counts(words.filter("lang <> 'en'")))


@query("tk15_unseen_tokens", X.sql(*_UNSEEN, body="select token, n, rank from unseen"))
def unseen_tokens(spark, sf):
    return _unseen(spark, sf)


@query("tk16_rows_with_unseen", X.sql(*_UNSEEN, """
hit as (select distinct doc_id from (select doc_id, unnest(tokens) token from words) where token in (select token from unseen))""", body="""
select source, count(*) as n, count(*) filter (doc_id in (select doc_id from hit)) as n_unseen from documents group by 1"""))
def rows_with_unseen(spark, sf):
    words = _words(spark, sf)
    flags = T.rows_with_unseen(words, _unseen(spark, sf), ["doc_id"])
    return words.select("doc_id", "source").join(flags, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_unseen").alias("n_unseen")
    )


@query("tk16_contains_unseen_text", X.sql(X.D_LIB, body="""
select mol_id, contains(molecule,'@@') or contains(molecule,'B(O)') as has_part from lib"""))
def contains_unseen_text(spark, sf):
    return X.lib(spark, sf).select("mol_id", T.contains_any("molecule", ["@@", "B(O)"]).alias("has_part"))


@query("tk17_drop_token_ids", X.sql(*MOL, body="""
select mol_id, array_to_string(list_concat(list_filter(input_ids, lambda x: x not in (8,11,14)),
 list_transform(list_filter(input_ids, lambda x: x in (8,11,14)), lambda x: 0::bigint)), ',') as input_ids from enc"""))
def drop_token_ids(spark, sf):
    out = _mol_ids(spark, sf).withColumn("input_ids", T.drop_token_ids("input_ids", [8, 11, 14]))
    return out.select("mol_id", joined("input_ids").alias("input_ids"))


@query("tk18_multi_hot", X.sql(*MOL, "v as (select count(*) n from vocab)", body="""
select mol_id, array_to_string(list_transform(range(1,n), lambda i: list_contains(input_ids,i)::int), ',') as hot,
 array_to_string(list_sort(list_distinct(input_ids)), ',') as present from enc, v"""))
def multi_hot(spark, sf):
    n = _mol_vocab(spark, sf).count()
    out = _mol_ids(spark, sf).select("mol_id", T.multi_hot("input_ids", n).alias("hot"), T.present_ids("input_ids").alias("present"))
    return out.select("mol_id", joined("hot").alias("hot"), joined("present").alias("present"))


@query("tk19_char_index", X.sql(X.D_LIB, X.D_TRAIN, X.D_TEST, """
c as (select mol_id, string_split(molecule,'') tokens from lib)""", """
abc as (select token, row_number() over (order by token) as id from (select distinct unnest(tokens) token from c))""",
    "w as (select max(len(molecule)) n from lib)", d_encode("c", "mol_id", "abc"), body="""
select mol_id, array_to_string(list_concat(input_ids, list_transform(range(0, n-len(input_ids)), lambda x: 0::bigint)), ',') as char_ids from enc, w"""))
def char_index(spark, sf):
    lib = X.lib(spark, sf)
    chars = lib.select(F.explode(T.characters("molecule")).alias("value")).distinct()
    alphabet = T.row_index(chars, ["value"], "id").select(F.col("value").alias("token"), (F.col("id") + 1).alias("id"))
    width = T.longest_text((X.train(spark, sf), "molecule"), (X.test(spark, sf), "molecule"))
    out = T.char_index(lib, "molecule", alphabet, width, ["mol_id"])
    return out.select("mol_id", joined("char_ids").alias("char_ids"))


@query("tk20_remap_ids", X.sql(*MOL, "neu as (select token, row_number() over (order by token)-1 as id from vocab where token<>'Cl')",
    d_encode("mol", "mol_id", "(select vocab.token, coalesce(neu.id,-999) id from vocab left join neu using (token))", "enc2"),
    body=f"select mol_id, {text('input_ids')} from enc2"))
def remap_ids(spark, sf):
    vocab = _mol_vocab(spark, sf)
    new = T.row_index(vocab.filter("token <> 'Cl'").select("token"), ["token"], "id")
    out = T.remap_ids(_mol_ids(spark, sf), vocab, new, ["mol_id"])
    return out.select("mol_id", joined("input_ids").alias("input_ids"))


@query("tk20_encoding_mismatches", X.sql(X.D_LIB, body="""
select count(*) as n, count(*) filter (contains(molecule,'Cl')) as n_different, 0::bigint as n_missing from lib"""))
def encoding_mismatches(spark, sf):
    mol, vocab = _mol(spark, sf), _mol_vocab(spark, sf)
    a = T.encode(mol, vocab, ["mol_id"])
    b = T.encode(mol, vocab.filter("token <> 'Cl'"), ["mol_id"])
    return T.encoding_mismatches(a, b, ["mol_id"])


@query("tk21_count_unk", X.sql(D_WORDS, "en as (select distinct unnest(tokens) token from words where lang='en')",
    "u as (select doc_id, count(*) n from (select doc_id, unnest(tokens) token from words) where token not in (select token from en) group by 1)",
    body="select count(*) as n_rows, sum(n)::bigint as n_unk from u"))
def count_unk(spark, sf):
    words = _words(spark, sf)
    vocab = T.build_vocab(T.token_counts(words.filter("lang = 'en'")))
    return T.count_unk(T.encode(words, vocab, ["doc_id"]))


D_GRAMS = """c as (select doc_id, string_split(text,'') c from documents),
grams as (select doc_id, list_transform(range(1, len(c)-2), lambda i: c[i]||c[i+1]||c[i+2]||c[i+3]) g from c)"""


def _d_text_hash(g: str, bits: int) -> str:
    return f"(('0x'||substr(md5({g}),1,13))::bigint >> {52 - bits})"


@query("tk22_qgram_fingerprint", X.sql(D_GRAMS, f"""
b as (select doc_id, list_distinct(list_transform(g, lambda x: {_d_text_hash('x', 10)}%1024)) b from grams)""", body="""
select doc_id, array_to_string(list_transform(range(0,32), lambda w: coalesce(list_sum(list_transform(list_filter(b, lambda x: x//32=w),
 lambda x: (1::bigint << (x%32)::int))),0)::bigint), ',') as words from b"""))
def qgram_fingerprint(spark, sf):
    out = T.qgram_fingerprint(X.table(spark, sf, "documents"), ["doc_id"], "text")
    return out.select("doc_id", joined("words").alias("words"))


@query("tk22_qgram_counts", X.sql(D_GRAMS, body=f"""
select bit, count(*) as n_docs, sum(n)::bigint as n from (select doc_id, {_d_text_hash('x', 10)}%1024 as bit, count(*) as n
 from (select doc_id, unnest(g) x from grams) group by all) group by bit"""))
def qgram_counts(spark, sf):
    cells = T.qgram_fingerprint(X.table(spark, sf, "documents"), ["doc_id"], "text", counts=True)
    return cells.groupBy("bit").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))


_FAMILY = ", ".join(f"({i},{a},{b})" for i, (a, b) in enumerate(T.hash_family(32, 42)))


@query("tk23_minhash_signature", X.sql(D_GRAMS, f"fam as (select i, a::bigint a, b::bigint b from (values {_FAMILY}) f(i,a,b))", f"""
hs as (select distinct doc_id, {_d_text_hash('x', 31)}%2147483647 h from (select doc_id, unnest(g) x from grams))""", """
mn as (select doc_id, i, min((a*h+b)%2147483647) m from hs, fam group by all)""", body="""
select doc_id, array_to_string(list(coalesce(m,2147483647) order by fam.i), ',') as signature from documents cross join fam left join mn using (doc_id, i) group by doc_id"""))
def minhash_signature(spark, sf):
    docs = X.table(spark, sf, "documents")
    out = docs.select("doc_id", T.minhash_signature("text", n_hashes=32).alias("signature"))
    return out.select("doc_id", joined("signature").alias("signature"))
