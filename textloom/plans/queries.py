"""Queries of the library's own operators over the driver's tables, with the same queries in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignments, arithmetic, codes, edits, evaluation, intersections, means, measures, names, phones, rewrites, tokenizers, vectors
from ..operators import corpus, matching
from ..streaming import counts_by_window, sessions


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens_query(fn):
    def run(spark, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(fn(F.col("text")), "|").alias("tokens"))

    return run


def _tokens_sql(expr: str) -> str:
    return f"select item_id, array_to_string({expr}, '|') as tokens from benchmark"


def unigrams(spark, sf_dir: str) -> DataFrame:
    return corpus.unigrams(corpus.words(_table(spark, sf_dir, "documents")))


def idf(spark, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return corpus.idf(corpus.unigrams(corpus.words(documents)), documents.count()).select("word", F.round("idf", 9).alias("idf"))


def tf_idf(spark, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return corpus.tf_idf(corpus.words(documents), documents.count()).select("doc_id", "word", F.round("tf_idf", 9).alias("tf_idf"))


def bigrams(spark, sf_dir: str) -> DataFrame:
    return corpus.n_grams(_table(spark, sf_dir, "documents"))


def n_grams_up_to_3(spark, sf_dir: str) -> DataFrame:
    return corpus.n_grams_up_to(_table(spark, sf_dir, "conversations"))


def onsets(spark, sf_dir: str) -> DataFrame:
    return tokenizers.onsets(corpus.words(_table(spark, sf_dir, "documents")))


def legal_syllables(spark, sf_dir: str) -> DataFrame:
    """Syllables of the benchmark by the onsets of documents; onsets are fewer than 5,000 by their threshold."""
    legal = [row.onset for row in onsets(spark, sf_dir).collect()]
    return tokens_query(lambda c: tokenizers.legality(c, legal))(spark, sf_dir)


def _names(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct().withColumn("block", F.substring("text", 1, 1)).withColumn("id", F.col("text"))


def blocking(spark, sf_dir: str) -> DataFrame:
    """Distinct part names with the same first letter, and their Levenshtein distance."""
    return matching.self_pairs(_names(spark, sf_dir), "block").select("src", "tar", F.levenshtein("src", "tar").alias("distance"))


def best_matches(spark, sf_dir: str) -> DataFrame:
    pairs = blocking(spark, sf_dir).withColumn("closeness", -F.col("distance"))
    return matching.top_k(pairs, 2, "src", "closeness").select("src", "tar", "distance", "rank")


def pair_statistics(spark, sf_dir: str) -> DataFrame:
    pairs = matching.self_pairs(_names(spark, sf_dir), "block")
    rows = matching.pair_statistics(pairs, lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    return rows.select(*(F.round(c, 9).alias(c) for c in rows.columns))


def collisions(spark, sf_dir: str) -> DataFrame:
    """Fingerprints that several distinct words of the documents share."""
    words = codes.words_of_documents(_table(spark, sf_dir, "documents"))
    return matching.key_collisions(words, rewrites.q_gram_fingerprint(F.col("word")), "word")


def full_name_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of names of two words."""
    return _names(spark, sf_dir).select(F.col("text").alias("word"), rewrites.code("spfc", F.col("text")).alias("code"))


def phonetic_fingerprints(spark, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select(F.col("text").alias("word"), rewrites.phonetic_fingerprint(F.col("text")).alias("code"))


def phonetic_names(spark, sf_dir: str) -> DataFrame:
    """How near the phonetic codes of neighbouring part names are."""
    pairs = measures.pairs_of_parts(_table(spark, sf_dir, "part"))
    return pairs.select("id", "src", "tar", F.round(rewrites.phonetic_similarity(F.col("src"), F.col("tar"), ("double_metaphone",), "levenshtein"), 9).alias("sim"))


def q_gram_join(spark, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("text"))
    return matching.q_gram_join(names, names, 0.6).where("src < tar").select("src", "tar", F.round("sim", 9).alias("sim"))


MEANS = {n: getattr(means, n) for n in ("amean", "gmean", "hmean", "qmean", "cmean", "lehmer_mean", "hoelder_mean", "heronian_mean", "midrange", "median", "mode", "var", "std")}
_X = "[l_quantity::double, l_linenumber::double, 1 + l_tax]"
_S = "list_sum(list_transform(x, lambda v: {}))"
MEANS_SQL = {
    "amean": _S.format("v") + "/3", "gmean": "power(x[1]*x[2]*x[3], 1e0/3)", "hmean": "case when x[1] = x[2] and x[2] = x[3] then x[1] else 3/" + _S.format("1/v") + " end", "qmean": f"sqrt({_S.format('v*v')}/3)",
    "cmean": f"{_S.format('v*v')}/{_S.format('v')}", "lehmer_mean": f"{_S.format('v*v')}/{_S.format('v')}", "hoelder_mean": f"sqrt({_S.format('v*v')}/3)",
    "heronian_mean": "(x[1] + x[2] + x[3] + sqrt(x[1]*x[2]) + sqrt(x[1]*x[3]) + sqrt(x[2]*x[3]))/6", "midrange": "(list_max(x) + list_min(x))/2", "median": "list_sort(x)[2]",
    "mode": "case when x[2] = x[3] and x[1] <> x[2] then x[2] else x[1] end", "var": f"{_S.format('power(v - list_sum(x)/3, 2)')}/3", "std": f"sqrt({_S.format('power(v - list_sum(x)/3, 2)')}/3)",
}


def all_means(spark, sf_dir: str) -> DataFrame:
    nums = F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"), F.lit(1.0) + F.col("l_tax"))
    rows = _table(spark, sf_dir, "lineitem").withColumn("x", nums)
    return rows.select("l_orderkey", "l_linenumber", *(F.round(fn(F.col("x")), 6).alias(n) for n, fn in MEANS.items()))


PAIR_MEANS = {"lmean": means.lmean, "imean": means.imean, "seiffert_mean": means.seiffert_mean}
ITERATED = {"agmean": means.agmean, "ghmean": means.ghmean, "aghmean": means.aghmean}


def pair_means(spark, sf_dir: str) -> DataFrame:
    """Means of two values; the iterated ones once for each distinct pair."""
    rows = _table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.lit(1.0) + F.col("l_linenumber")).alias("x")).distinct()
    return rows.select(F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), *(F.round(fn(F.col("x")), 6).alias(n) for n, fn in PAIR_MEANS.items()), *(F.round(fn()(F.col("x")), 6).alias(n) for n, fn in ITERATED.items()))


def _iterated_sql(name: str, start: str, step: str, rounds: int = 12) -> str:
    found = f"select a, b, {start} from p"
    for _ in range(rounds):
        found = f"select a, b, {step} from ({found})"
    return f"{name} as ({found})"


_PAIR_MEANS_SQL = ", ".join((
    "with p as (select distinct l_quantity::double as a, 1.0::double + l_linenumber as b from lineitem)", _iterated_sql("ag", "(a + b)/2 as x, sqrt(a*b) as y", "(x + y)/2 as x, sqrt(x*y) as y"), _iterated_sql("gh", "sqrt(a*b) as x, 2*a*b/(a + b) as y", "sqrt(x*y) as x, 2*x*y/(x + y) as y"),
    _iterated_sql("agh", "(a + b)/2 as x, sqrt(a*b) as y, 2*a*b/(a + b) as z", "(x + y + z)/3 as x, power(x*y*z, 1e0/3) as y, 3/(1/x + 1/y + 1/z) as z"),
)) + " select a, b, round(case when a = b then a else (b - a)/ln(b/a) end, 6) as lmean, round(case when a = b then a else exp((a*ln(a) - b*ln(b))/(a - b) - 1) end, 6) as imean, round(case when a = b then 'nan'::double else (a - b)/(2*asin((a - b)/(a + b))) end, 6) as seiffert_mean, round(ag.x, 6) as agmean, round(gh.x, 6) as ghmean, round(agh.x, 6) as aghmean from p join ag using (a, b) join gh using (a, b) join agh using (a, b)"


def mean_similarity(spark, sf_dir: str) -> DataFrame:
    """Harmonic mean of one and the similarity of names that share a first letter, so that no term is zero."""
    pairs = matching.self_pairs(_names(spark, sf_dir), "block")
    rows = matching.mean_pairwise_similarity(pairs, lambda a, b: 2 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    return rows.select(F.round("mean", 9).alias("mean"))


def skipgrams(spark, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select(F.col("text").alias("name"), F.array_join(tokenizers.q_skipgrams(2)(F.col("text")), "|").alias("tokens"))


def arithmetic_codes(spark, sf_dir: str) -> DataFrame:
    """Bits of each name under a code learnt from it, and the name decoded again."""

    def coded(names):
        for batch in names:
            ranges = [arithmetic.train(t) for t in batch.text]
            codes_ = [arithmetic.encode(t, r) for t, r in zip(batch.text, ranges, strict=True)]
            yield batch[["text"]].assign(bits=[b for _, b in codes_], decoded=[arithmetic.decode(*c, r) for c, r in zip(codes_, ranges, strict=True)])

    return _names(spark, sf_dir).select("text").mapInPandas(coded, "text string, bits long, decoded string")


def _events(windows):
    def run(spark, sf_dir: str) -> DataFrame:
        rows = windows(_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
        return rows.select(F.unix_timestamp("window.start").alias("start"), F.unix_timestamp("window.end").alias("end"), "key", "n")

    return run


_EVENTS_SQL = "select epoch({0})::bigint as start, epoch({0} + interval 1 hour)::bigint as end, event_type as key, count(*) as n from {1} group by all"

_BIGRAMS = "case when length({0}) = 0 then []::varchar[] else list_transform(range(1, length({0}) + 2), lambda i: substr('$' || {0} || '#', i, 2)) end"
_NAME_SQL = "names as (select distinct p_name as t from part), pairs as (select l.t as src, r.t as tar from names l join names r on substr(l.t, 1, 1) = substr(r.t, 1, 1) and l.t < r.t)"
_WORDS = "words as (select doc_id, unnest(regexp_extract_all(text, '\\S+')) as word from documents)"
_COUNTS = f"{_WORDS}, counts as (select word, count(*) as count, count(distinct doc_id) as doc_count from words group by word)"

QUERIES = {
    **{f"sim_{n}": measures.query(n) for n in measures.NAMES},
    **{f"sim_{n}": vectors.query(n) for n in vectors.NAMES},
    **{f"sim_{n}": edits.query(n) for n in edits.NAMES},
    **{f"sim_{n}": alignments.query(n) for n in alignments.NAMES},
    **{f"sim_{n}": phones.query(n) for n in phones.NAMES},
    **{f"code_{n}": codes.query(n) for n in codes.NAMES},
    **{f"code_{n}": rewrites.query(n) for n in rewrites.NAMES},
    **{f"sim_{kind}_{n}": intersections.query(n, kind) for kind in intersections.KINDS for n in ("jaccard", "dice", "cosine", "overlap")},
    "code_spfc": full_name_codes,
    "code_fp_phonetic": phonetic_fingerprints,
    "sim_phonetic": phonetic_names,
    "sim_synoname": names.kind_query,
    "code_fp_synoname": names.toolcode_query,
    "confusion_metrics": evaluation.query,
    "means": all_means,
    "means_of_pairs": pair_means,
    "match_mean_similarity": mean_similarity,
    "tokens_q_skipgrams": skipgrams,
    "coding_arithmetic": arithmetic_codes,
    "stream_tumbling": _events(lambda rows: counts_by_window(rows, "ts", F.col("event_type"))),
    "stream_sliding": _events(lambda rows: counts_by_window(rows, "ts", F.col("event_type"), slide="20 minutes")),
    "stream_sessions": _events(lambda rows: sessions(rows, "ts", F.col("user_id"))),
    "tokens_character": tokens_query(tokenizers.character),
    "tokens_q_grams": tokens_query(tokenizers.q_grams),
    "tokens_trigrams": tokens_query(lambda c: tokenizers.q_grams(c, 3)),
    "tokens_whitespace": tokens_query(tokenizers.whitespace),
    "tokens_regexp": tokens_query(tokenizers.regexp),
    "tokens_wordpunct": tokens_query(tokenizers.wordpunct),
    "tokens_c_or_v_cluster": tokens_query(tokenizers.c_or_v_cluster),
    "tokens_cv_cluster": tokens_query(tokenizers.cv_cluster),
    "tokens_vc_cluster": tokens_query(tokenizers.vc_cluster),
    "tokens_saps": tokens_query(tokenizers.saps),
    "tokens_sonority": tokens_query(tokenizers.sonority),
    "tokens_legality": legal_syllables,
    "phones_of_words": phones.words_query,
    "corpus_onsets": onsets,
    "corpus_n_grams": n_grams_up_to_3,
    "corpus_unigrams": unigrams,
    "corpus_idf": idf,
    "corpus_tf_idf": tf_idf,
    "corpus_bigrams": bigrams,
    "match_blocking": blocking,
    "match_top_k": best_matches,
    "match_pair_statistics": pair_statistics,
    "match_q_gram_join": q_gram_join,
    "match_key_collisions": collisions,
}
SQL = {
    **{f"sim_{n}": measures.sql(n) for n in measures.NAMES},
    **{f"sim_{n}": vectors.sql(n) for n in vectors.NAMES},
    **{f"sim_{n}": edits.sql(n) for n in edits.SQL},
    **{f"code_{n}": codes.sql(n) for n in codes.NAMES},
    **{f"code_{n}": rewrites.sql(n) for n in rewrites.SQL},
    "confusion_metrics": evaluation.SQL,
    "means": f"with t as (select l_orderkey, l_linenumber, {_X} as x from lineitem) select l_orderkey, l_linenumber, " + ", ".join(f"round({MEANS_SQL[n]}, 6) as {n}" for n in MEANS) + " from t",
    "means_of_pairs": _PAIR_MEANS_SQL,
    "match_mean_similarity": f"with {_NAME_SQL}, s as (select 2 - levenshtein(src, tar)/greatest(length(src), length(tar)) as sim from pairs) select round(count(*)/sum(1/sim), 9) as mean from s",
    "tokens_q_skipgrams": "with n as (select distinct p_name as name, '$' || p_name || '#' as t from part) select name, array_to_string(flatten(list_transform(range(1, length(t)), lambda i: list_transform(range(i + 1, length(t) + 1), lambda j: substr(t, i, 1) || substr(t, j, 1)))), '|') as tokens from n",
    "stream_tumbling": _EVENTS_SQL.format("date_trunc('hour', ts)", "events"),
    "stream_sliding": _EVENTS_SQL.format("at_", "(select time_bucket(interval 20 minute, ts) - unnest([0, 1, 2]) * interval 20 minute as at_, event_type from events)"),
    "stream_sessions": "with e as (select *, coalesce(ts >= lag(ts) over w + interval 30 minute, true)::int as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e) select floor(epoch(min(ts)))::bigint as start, floor(epoch(max(ts) + interval 30 minute))::bigint as end, user_id as key, count(*) as n from s group by user_id, k",
    "tokens_character": _tokens_sql("list_transform(range(1, length(text) + 1), lambda i: substr(text, i, 1))"),
    "tokens_q_grams": _tokens_sql(_BIGRAMS.format("text")),
    "tokens_trigrams": _tokens_sql("list_transform(range(1, length(text) + 3), lambda i: substr('$$' || text || '##', i, 3))"),
    "tokens_whitespace": _tokens_sql("regexp_extract_all(text, '\\S+')"),
    "tokens_regexp": _tokens_sql("regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"),
    "tokens_wordpunct": _tokens_sql("regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+')"),
    "corpus_unigrams": f"with {_COUNTS} select word, count, doc_count from counts",
    "corpus_idf": f"with {_COUNTS} select word, round(ln((select count(*) from documents)::double/doc_count), 9) as idf from counts",
    "corpus_tf_idf": f"with {_COUNTS}, tf as (select doc_id, word, count(*) as tf from words group by all), w as (select doc_id, word, ln(1 + tf)*ln(1 + (select count(*) from documents)::double/doc_count) as w from tf join counts using (word)) select doc_id, word, round(w/sqrt(sum(w*w) over (partition by doc_id)), 9) as tf_idf from w",
    "corpus_bigrams": "with s as (select unnest(string_split(text, chr(10))) as s from documents), p as (select list_concat(['_START_'], regexp_extract_all(s, '\\S+'), ['_END_']) as p from s) select ngram, count(*) as count from (select unnest(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) as ngram from p) group by ngram",
    "corpus_n_grams": "with s as (select unnest(string_split(text, chr(10))) as s from conversations), p as (select list_concat(['_START_'], regexp_extract_all(s, '\\S+'), ['_END_']) as p from s), g as (select p, unnest(range(1, len(p) + 1)) as i from p), k as (select p, i, unnest(range(1, least(3, len(p) - i + 1) + 1)) as k from g) select array_to_string(p[i:i + k - 1], ' ') as ngram, k::int as size, count(*) as count from k group by all",
    "corpus_onsets": f"with {_WORDS}, o as (select regexp_extract(lower(regexp_replace(word, '[^\\p{{L}}]', '', 'g')), '^[^aeiouy]*') as onset from words), c as (select onset, count(*) as n from o group by onset) select onset, n from c where n > 0.0002 * (select sum(n) from c)",
    "match_blocking": f"with {_NAME_SQL} select src, tar, levenshtein(src, tar)::int as distance from pairs",
    "match_top_k": f"with {_NAME_SQL}, d as (select src, tar, levenshtein(src, tar)::int as distance from pairs) select src, tar, distance, rank() over (partition by src order by distance)::int as rank from d qualify rank() over (partition by src order by distance) <= 2",
    "match_pair_statistics": f"with {_NAME_SQL}, s as (select 1 - levenshtein(src, tar)/greatest(length(src), length(tar)) as sim from pairs) select round(max(sim), 9) as max, round(min(sim), 9) as min, round(avg(sim), 9) as mean, round(stddev_pop(sim), 9) as std from s",
    "match_key_collisions": f"with {codes.WORDS_SQL}, n as (select word as t, regexp_replace(translate(lower(word), '{codes.ACCENTS[0]}', '{codes.ACCENTS[1]}'), '[^\\p{{L}}\\p{{N}}]', '', 'g') as s from words), k as (select t, array_to_string(list_sort(list_distinct([substr(s, i, 2) for i in range(1, length(s))])), '') as key from n) select key, count(*) as n, min(t) as least, max(t) as greatest from k group by key having count(*) > 1",
    "match_q_gram_join": f"with names as (select distinct p_name as t, list_distinct({_BIGRAMS.format('p_name')}) as g from part), s as (select l.t as src, r.t as tar, len(list_intersect(l.g, r.g)) as i, len(l.g) as x, len(r.g) as y from names l join names r on l.t < r.t) select src, tar, round(i/(x + y - i), 9) as sim from s where i/(x + y - i) >= 0.6",
}
