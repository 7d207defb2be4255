"""Fill-in-the-middle: texts cut in three at token bounds and put in another order.

The cuts of a whole Arrow batch are found at once on its UTF-8 buffer: a table
of byte classes tells white space, neighbouring bytes tell where a token
starts, running sums that begin anew with each text number the tokens, and one
search finds the cuts of all rows. Python loops over slices of a bounded number
of bytes, never over rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import columns_of, require, unused

#: What stands before the three parts in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that are cut at once, some ten bytes of memory for each; a longer text is a slice of its own.
SLICE = 1 << 22
#: White space ends a token: the bytes 0x20 and 0x09 to 0x0D. Bytes of longer characters are none of these.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def cut_slice(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in each text, and the bytes where its prefix and its middle end.

    ``data`` holds the bytes of consecutive texts, which ``bounds`` part, one
    bound more than texts; ``first`` and ``second`` are the draws of each row.
    """
    begins, ends = bounds[:-1], bounds[1:]
    space = _SPACE[data]
    starts = np.empty(len(data), bool)
    starts[:1] = True
    np.greater(space[1:], space[:-1], out=starts[1:])  # white space behind another byte starts a token
    filled = begins < ends
    starts[begins[filled]] = True
    # A running number over the slice, its value before each text taken off again where it is used.
    number = np.cumsum(starts, dtype=np.int32 if len(data) < 2**31 else np.int64)
    upto = np.concatenate([[0], number])
    before = upto[begins]
    n = upto[ends] - before
    draws = np.stack([first % (n + 1), second % (n + 1)])
    cuts = []
    for units in (draws.min(0), draws.max(0)):
        # The token after so many units starts where the number first gets past them; past the last, the text ends.
        at = np.searchsorted(number, (before + units + 1).astype(number.dtype), side="left")
        cuts.append(np.where(units < n, at, ends))
    return n, cuts[0], cuts[1]


def _parts(texts: pa.Array, first: pa.Array, second: pa.Array, moved: pa.Array) -> pa.Array:
    """A struct (n, prefix, middle, suffix) for each text; the parts are null where ``moved`` is false."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    first, second, moved = (np.asarray(x) for x in (first, second, moved))
    if not len(texts):
        return pa.array([], pa.struct(_FIELDS))
    _, offsets, buffer = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    n, low, high = (np.empty(len(texts), np.int64) for _ in range(3))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, side="right")) - 1)
        own, base = slice(at, upto), bounds[at]
        n[own], low[own], high[own] = cut_slice(data[base : bounds[upto]], bounds[at : upto + 1] - base, first[own], second[own])
        low[own] += base
        high[own] += base
        at = upto
    # The parts lie one behind another in the same buffer: strings between the cuts need no copy until they are taken.
    marks = np.empty(3 * len(texts) + 1, np.int64)
    marks[0::3], marks[1::3], marks[2::3] = bounds, low, high
    parts = pa.LargeStringArray.from_buffers(3 * len(texts), pa.py_buffer(marks), buffer or pa.py_buffer(b""))
    rows = pa.array(np.arange(len(texts)) * 3, mask=~moved.astype(bool))
    prefix, middle, suffix = (parts.take(pa.compute.add(rows, k)).cast(pa.string()) for k in range(3))
    return pa.StructArray.from_arrays([pa.array(n), prefix, middle, suffix], fields=_FIELDS)


_FIELDS = [pa.field("n", pa.int64()), pa.field("prefix", pa.string()), pa.field("middle", pa.string()), pa.field("suffix", pa.string())]


@F.arrow_udf(StructType([StructField("n", LongType()), *(StructField(c, StringType()) for c in ("prefix", "middle", "suffix"))]))
def _cut(texts: pa.Array, first: pa.Array, second: pa.Array, moved: pa.Array) -> pa.Array:
    return _parts(texts, first, second, moved)


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight digits of a hexadecimal digest, as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with fim_n (tokens), fim_form, fim_prefix, fim_middle, fim_suffix and fim_output.

    A token is a run of other characters with the white space before it, or the
    white space at the text's end. Two draws, from the SHA-256 of the seed and
    the id, say after how many tokens the prefix and the middle end; two more
    say whether a text is moved (``rate`` of a hundred), and if so whether the
    suffix comes first (``spm`` of a hundred). ``fim_form`` is ``plain`` (the
    output is the text; the parts are null), ``psm`` or ``spm``.

    An empty or null text is plain with an empty output, and so is one that
    holds a mark of the format, as it could not be taken apart again. A null id
    draws as an id without digits. Equal ids draw alike, so repeated rows come
    out equal. Very long texts take time in proportion; an empty table gives no
    rows. Other columns stay as they are: where one has a name of the above,
    the new one gets an underscore before it. There is no shuffle.
    """
    require(docs, id_col, text_col)
    n, form, prefix, middle, suffix, output, digest, cut = unused(docs, "fim_n", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output", "fim_digest", "fim_cut")
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = docs.withColumn(digest, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256))
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (_draw(F.col(digest), 3) % 100 >= rate)
    made = made.withColumn(form, F.when(plain, "plain").when(_draw(F.col(digest), 4) % 100 < spm, "spm").otherwise("psm"))
    made = made.withColumn(cut, _cut(F.col(text_col), _draw(F.col(digest), 1), _draw(F.col(digest), 2), F.col(form) != "plain"))
    part = F.col(cut).getField
    psm = F.concat(F.lit(PREFIX), part("prefix"), F.lit(SUFFIX), part("suffix"), F.lit(MIDDLE), part("middle"))
    spm_ = F.concat(F.lit(SUFFIX), part("suffix"), F.lit(PREFIX), part("prefix"), F.lit(MIDDLE), part("middle"))
    return made.select(
        *columns_of(docs),
        part("n").alias(n),
        form,
        part("prefix").alias(prefix),
        part("middle").alias(middle),
        part("suffix").alias(suffix),
        F.when(F.col(form) == "plain", text).when(F.col(form) == "psm", psm).otherwise(spm_).alias(output),
    )


def restore(output: Column, form: Column) -> Column:
    """The text from which an output of the form was made; only the two are used."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    whole = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(whole)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:lo], '') AS pre, array_to_string(units[lo + 1:hi], '') AS mid, array_to_string(units[hi + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
