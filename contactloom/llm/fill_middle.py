"""Fill-in-the-middle texts by escaped marker injection, in built-in functions alone.

A delimiter character that a text may hold itself is escaped, ``regexp_replace`` appends the
delimiter after every unit, and the number of units is the growth in length. Which ranks cut the
text is drawn from a digest of its id, ``substring_index`` takes the units before, between and behind
them, and what was escaped is put back. Prefix, middle and suffix are then assembled under markers; a text that
holds a marker itself stays as it is, so that an output tells its parts without doubt: no marker
overlaps another one or itself.

Every row is worked out by itself: no shuffle, no Python, and a row's memory is about three times its
text. Defined cases: a null text is an empty one, and an empty one is plain; a null id draws as an empty
one does; repeated rows give the same output again, and so do tasks that run again; further columns are
left alone, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a text: runs of ASCII letters, and single other code points.
UNITS = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Out of a hundred texts, so many stay plain; out of a hundred others, so many have their suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SALT = "1:"

# the delimiter, the escape, and what follows the escape in place of either
_CUT, _ESC, _FOR_ESC, _FOR_CUT = "\x01", "\x02", "\x03", "\x04"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + _FOR_ESC)), F.lit(_CUT), F.lit(_ESC + _FOR_CUT))


def _unescaped(part: Column) -> Column:
    """The part without its delimiters; an escape is never followed by anything but the two characters that stand for something."""
    bare = F.replace(part, F.lit(_CUT), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESC + _FOR_CUT), F.lit(_CUT)), F.lit(_ESC + _FOR_ESC), F.lit(_ESC))


def _draw(doc_id: Column, k: int, salt: str) -> Column:
    """The k-th group of eight hexadecimal digits of the id's digest, as a number."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", units: str = UNITS, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, salt: str = SALT, out_col: str = "fim", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all of them unless given) and ``out_col``, a struct: ``n`` units, ``form`` (plain, psm or spm), the parts
    (null if plain) and ``output``.

    ``units`` is a Java pattern that matches every character in some unit; a pattern other than the given one must take an escaped
    character, ``\\x02`` and ``\\x03`` or ``\\x04``, as one too.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # an escaped character is one unit, as the character itself is
    pattern = f"{_ESC}[{_FOR_ESC}{_FOR_CUT}]|{units}"
    h = [None, *(_draw(F.col(f"`{doc_col}`"), k, salt) for k in (1, 2, 3, 4))]
    own = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    names = [f"c{k}" for k in range(len(own))]  # work columns can't clash with these
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (h[3] % 100 >= 100 - plain_percent)
    marked = docs.select(*(c.alias(n) for c, n in zip(own, names)), text.alias("text"), F.when(plain, "plain").when(h[4] % 100 < spm_percent, "spm").otherwise("psm").alias("form"), h[1].alias("h1"), h[2].alias("h2"), F.regexp_replace(_escaped(text), pattern, f"$0{_CUT}").alias("marked"))
    counted = marked.withColumn("n", F.char_length("marked") - F.char_length(F.replace(F.col("marked"), F.lit(_CUT), F.lit(""))))
    ranks = counted.withColumn("first", F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).cast("int")).withColumn("last", F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).cast("int"))
    parts = ranks.withColumn("head", F.expr(f"substring_index(marked, '{_CUT}', last)"))
    parts = parts.select(*names, "text", "form", F.col("n").cast("long").alias("n"), _unescaped(F.expr(f"substring_index(head, '{_CUT}', first)")).alias("prefix"), _unescaped(F.expr(f"substring_index(head, '{_CUT}', first - last)")).alias("middle"), _unescaped(F.expr(f"substring_index(marked, '{_CUT}', last - n - 1)")).alias("suffix"))
    framed = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")).otherwise(F.col("text"))
    only = lambda c: F.when(F.col("form") != "plain", F.col(c)).alias(c)
    done = F.struct("n", "form", only("prefix"), only("middle"), only("suffix"), framed.alias("output")).alias(out_col)
    return parts.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns if keep is None else keep)), done)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    after = lambda mark: F.substring_index(output, mark, -1)
    middle = after(MIDDLE)
    inner = lambda first, second: F.substring_index(after(first), second, 1)
    psm = F.concat(F.substring_index(F.substring_index(output, SUFFIX, 1), PREFIX, -1), middle, inner(SUFFIX, MIDDLE))
    spm = F.concat(inner(PREFIX, MIDDLE), middle, F.substring_index(F.substring_index(output, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


QUERY = "op11_fill_in_middle"


def query(spark, sf_dir: str) -> DataFrame:
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    chars = lambda c: F.char_length(c).cast("long")
    return made.select("doc_id", "fim.n", "fim.form", chars("fim.prefix").alias("prefix_chars"), chars("fim.middle").alias("middle_chars"), F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4 FROM cut
), parts AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""
