r"""Fill-in-middle transformation (operator 12), by escaped marker injection; built-in functions only.

A text is cut into units, Latin words or single other code points, at two places that its id decides:
prefix, middle and suffix. One regexp_replace puts a delimiter behind each unit, the delimiters are counted,
and substring_index takes the parts before, between and behind the chosen ranks. U+0001 is the delimiter.
Where a text has U+0001 or the escape sign U+0002 itself, these become U+0002 and a digit, which the
pattern takes as one unit; the parts are unescaped before they are assembled.

Forms: psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle, plain is the text. restored()
rebuilds the text from output and form alone. It can't go wrong: only texts without <P>, <S> and <M> are
marked, and a mark that text and mark made together would need "<" in the middle of a mark.

Defined cases: a null text is empty, an empty text is plain with no units; a text with a mark in it stays
plain; a null id draws by the empty string; rows with one id and text come out alike, each for itself; other
columns are ignored; an empty table gives an empty result. Very long texts are scanned a bounded
number of times, by Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK, _ESCAPE = "\x01", "\x02"
#: A unit of escaped text.
_UNIT = rf"[A-Za-z]+|{_ESCAPE}[01]|[^A-Za-z]"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_MARK), F.lit(_ESCAPE + "1"))


def _unescaped(marked: Column) -> Column:
    bare = F.replace(marked, F.lit(_MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESCAPE + "1"), F.lit(_MARK)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))


def _parts(marked: Column, count: Column) -> Column:
    """The first `count` marked units, or the last ones behind the text's closing delimiter for a negative count."""
    return F.call_function("substring_index", marked, F.lit(_MARK), count.cast("int"))


def draws(id_col: str = "doc_id", seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers that the id decides: the first groups of SHA-256 of "seed:id"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """Per row of docs: doc_id, n (units), form, prefix, middle, suffix (null if plain), output."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws("doc_id", seed)
    rows = rows.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"), F.regexp_replace(_escaped(F.col("text")), _UNIT, "$0" + _MARK).alias("marked"))
    rows = rows.withColumn("n", (F.octet_length("marked") - F.octet_length(F.replace(F.col("marked"), F.lit(_MARK), F.lit("")))).cast("long"))
    taken = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | taken | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "marked", "n", form.alias("form"), F.least(a, b).alias("p"), F.greatest(a, b).alias("m"))
    split = F.col("form") != "plain"
    before = _parts(F.col("marked"), F.col("m"))
    rows = rows.select(
        "doc_id", "text", "n", "form",
        F.when(split, _unescaped(_parts(F.col("marked"), F.col("p")))).alias("prefix"),
        # the last m - p of the first m units: these end without a delimiter
        F.when(split & (F.col("m") > F.col("p")), _unescaped(_parts(before, F.col("p") - F.col("m")))).when(split, "").alias("middle"),
        # the closing delimiter has an empty part behind it
        F.when(split, _unescaped(_parts(F.col("marked"), F.col("m") - F.col("n") - 1))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    head = F.call_function("substring_index", body, second, F.lit(1))
    rest = F.call_function("substring_index", body, second, F.lit(-1))
    tail, middle = F.call_function("substring_index", rest, F.lit(MIDDLE), F.lit(1)), F.call_function("substring_index", rest, F.lit(MIDDLE), F.lit(-1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
   sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 c AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
   CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
 p AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS m,
   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
 s AS (SELECT doc_id, text, n, form, array_to_string(u[1:p], '') AS prefix, array_to_string(u[p + 1:m], '') AS middle, array_to_string(u[m + 1:n], '') AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
   WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
 sha256(text) AS restored_sha256
FROM s
"""
