"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier occurrence (by doc_id, then place) has the same text, or a
text within the edit bound: one insertion, deletion or substitution of a character in `fuzzy_chars` characters,
but one at most. So lines of fewer characters, where one edit makes another word or number, go only with equal ones. Blank lines always stay.

Two lines within one edit agree in their first or in their second half, so a line
emits deletion variants of the other half only when its half is shared at all. A
variant is keyed by class (length of the shorter line), half, hash of the equal half,
hash of the rest of the other half, and for substitutions the place. Lines of equal
key are led by their earliest occurrence: each is paired with that one, never with all,
and the pair's edit distance is verified. For substitutions all lines of a key are
within one edit of each other; for insertions the shorter line is one text.

The hash of a variant is put together from hashes of pieces of about the root of its length, so a line
of n characters costs about n * sqrt(n) steps, not n * n.

Null texts stay null, empty texts stay empty. Rows of one id are ordered by a hash of
their text, equal ones by place in the input (for those, reading the input twice must give the same order, as files do);
a null id sorts first. Extra columns are kept as they are, but n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FUZZY_CHARS = 20
#: Lines of these characters only are blank.
BLANK = " \t\r\x0b\x0c"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("m"), F.split(F.col(text_col), "\n", -1).alias("lines"))


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def _pieces(text: Column, start: Column, size: Column, count: Column) -> Column:
    """`count` pieces of `size` characters each from place `start` (counted from 0) on."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.substring(text, (start + p * size + 1).cast("int"), size))


def _let(value: Column, use) -> Column:
    """use(value), the value being worked out once, however often it occurs."""
    return F.transform(F.array(value), use)[0]


def _sizes(n: Column) -> tuple[Column, Column]:
    """Size and number of the pieces of a string of n characters."""
    size = F.greatest(F.lit(32), F.ceil(F.sqrt(n))).cast("int")
    return size, F.greatest(F.lit(1), F.ceil(n / size)).cast("int")


def _hashed(pieces: Column) -> Column:
    return F.transform(pieces, lambda x, p: F.xxhash64(p, x))


def _whole(text: Column) -> Column:
    """A string's hash: that of its numbered pieces."""
    size, count = _sizes(F.length(text))
    return _let(F.struct(text.alias("text"), size.alias("size"), count.alias("count")), lambda x: _xor(_hashed(_pieces(x["text"], F.lit(0), x["size"], x["count"]))))


def _dropped(text: Column, shifts: bool) -> Column:
    """For each place (from 1) the hash of the string without that character. Not `shifts`: any hash that is equal for lines of one length which agree at all other places."""
    more = 1 if shifts else 0  # pieces are those of the string that is left, and those behind the place come from one character later

    def of_piece(x: Column, p: Column) -> Column:
        """The places that fall in piece p."""
        n, size, count = x["n"], x["size"], x["count"]
        piece = F.substring(x["text"], (p * size + 1).cast("int"), size + more)
        others = _xor(F.slice(x["here"], F.lit(1), p)).bitwiseXOR(_xor(F.slice(x["after"], p + 2, count)))
        places = F.when(p == count - 1, n - p * size).otherwise(size).cast("int")
        less = lambda y, i: F.concat(F.substring(y["piece"], F.lit(1), i), F.substring(y["piece"], i + 2, size + 1))
        return _let(F.struct(piece.alias("piece"), others.alias("others")), lambda y: F.transform(F.sequence(F.lit(0), places - 1), lambda i: F.struct((p * size + i + 1).alias("place"), y["others"].bitwiseXOR(F.xxhash64(p, less(y, i))).alias("rest"))))

    size, count = _sizes(F.length(text) - more)
    sized = F.struct(text.alias("text"), F.length(text).alias("n"), size.alias("size"), count.alias("count"))
    pieces = lambda x, start: _hashed(_pieces(x["text"], F.lit(start), x["size"], x["count"]))
    ready = _let(sized, lambda x: F.struct(x["text"].alias("text"), x["n"].alias("n"), x["size"].alias("size"), x["count"].alias("count"), pieces(x, 0).alias("here"), pieces(x, more).alias("after")))
    return _let(ready, lambda x: F.flatten(F.transform(F.sequence(F.lit(0), x["count"] - 1), lambda p: of_piece(x, p))))


def _within_one(a: Column, b: Column) -> Column:
    """Whether strings are within one edit: what follows their common prefix, found by halving, is the same but for one character. (Levenshtein distances take time by the square of the length.)"""
    n, m = F.length(a), F.length(b)
    longer = lambda lo, step: (lo + step <= F.least(n, m)) & (F.substring(a, F.lit(1), lo + step) == F.substring(b, F.lit(1), lo + step))
    common = F.aggregate(F.array(*[F.lit(1 << k) for k in range(29, -1, -1)]), F.lit(0), lambda lo, step: F.when(longer(lo, step), lo + step).otherwise(lo))
    rest = lambda x, skip: F.substring(x, common + 1 + skip, F.greatest(n, m))
    return F.when(F.abs(n - m) > 1, F.lit(False)).otherwise(rest(a, F.when(n < m, 0).otherwise(1)) == rest(b, F.when(m < n, 0).otherwise(1)))


def _key(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _halves(n: Column, line: Column, short: Column, half: int) -> tuple[Column, Column]:
    """(equal half, other half) of a line in the class of length `short`; the other half takes a surplus character."""
    cut = F.floor(short / 2).cast("int")
    first, second = (cut, None) if half == 0 else (n - (short - cut), None)
    left, right = F.substring(line, F.lit(1), first), F.substring(line, first + 1, n)
    return (left, right) if half == 0 else (right, left)


def _blank(line: Column | str) -> Column:
    return F.trim(line if isinstance(line, Column) else F.col(line), F.lit(BLANK)) == ""


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, n, first, times): each distinct line, its length, first occurrence (d, m, p) and count."""
    lines = _rows(docs, id_col, text_col).select("d", "m", F.posexplode("lines").alias("p", "line"))
    lines = lines.where(~_blank("line"))
    keyed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.length("line").alias("n"), F.struct("d", "m", "p").alias("at"))
    return keyed.groupBy("h1", "h2").agg(F.first("n").alias("n"), F.min("at").alias("first"), F.count("*").alias("times"))


def near_lines(docs: DataFrame, firsts: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """(h1, h2) of the distinct lines that an earlier line within one edit makes redundant."""
    lines = _rows(docs, id_col, text_col).select("d", "m", F.posexplode("lines").alias("p", "line")).where((F.length("line") >= fuzzy_chars) & ~_blank("line"))
    lines = lines.select("line", F.length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    n, line = F.col("n"), F.col("line")
    shared = []
    for longer in (0, 1):
        for half in (0, 1):
            equal, _ = _halves(n, line, n - longer, half)
            shared.append(_key(n - longer, F.lit(half), equal))
    keys = lines.select("h1", F.explode(F.array(*shared)).alias("key"))
    keys = keys.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).where("least <> most").select("key")
    keys = scratch.save(keys, "halves")
    # Lines that share a half with another line; the first pass over keys drops nearly all others.
    held = lines.select("line", "n", "h1", "h2", F.posexplode(F.array(*shared)).alias("way", "key"))
    held = held.join(keys, "key", "left_semi").groupBy("h1", "h2", "way").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    held = scratch.save(held.join(firsts.select("h1", "h2", "first"), ["h1", "h2"]), "candidates")
    emitted = []
    for longer in (0, 1):
        for half in (0, 1):
            equal, other = _halves(n, line, n - longer, half)
            mine = held.where(F.col("way") == 2 * longer + half).select("h1", "h2", "first", (n - longer).alias("class"), F.lit(half).alias("half"), F.xxhash64(equal).alias("equal"), other.alias("other"))
            size, dropped = F.length("other"), _dropped(F.col("other"), bool(longer))
            keyed = lambda kind, place, rest: _key(F.col("class"), F.col("half"), F.col("equal"), F.lit(kind), place, rest)
            if longer:
                ways = F.transform(dropped, lambda x: keyed("gap", F.lit(0), x["rest"]))
            else:
                ways = F.concat(F.array(keyed("gap", F.lit(0), _whole(F.col("other")))), F.transform(dropped, lambda x: keyed("swap", x["place"], x["rest"])))
            emitted.append(mine.where(size > 0).select("h1", "h2", "first", F.lit(longer).alias("longer"), F.explode(F.array_distinct(ways)).alias("key")))
    variants = emitted[0].unionByName(emitted[1]).unionByName(emitted[2]).unionByName(emitted[3])
    variants = scratch.save(variants, "variants")
    one = F.struct("first", "h1", "h2")
    # For insertions the longer and the shorter side lead each other; for substitutions only side 0 exists.
    led = variants.groupBy("key").agg(F.min(F.when(F.col("longer") == 0, one)).alias("short"), F.min(F.when(F.col("longer") == 1, one)).alias("long"))
    met = variants.join(led, "key").select("h1", "h2", "first", F.explode(F.array(F.col("short"), F.when(F.col("longer") == 0, F.col("long")))).alias("lead"))
    met = met.where(F.col("lead").isNotNull() & (F.col("lead.first") < F.col("first"))).select("h1", "h2", F.col("lead.h1").alias("g1"), F.col("lead.h2").alias("g2")).distinct()
    text = held.groupBy("h1", "h2").agg(F.first("line").alias("line"))
    lead = text.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("lead"))
    checked = met.join(text, ["h1", "h2"]).join(lead, ["g1", "g2"])
    return checked.where(_within_one(F.col("line"), F.col("lead"))).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """All rows with their columns, the text without repeated lines, and n_lines, n_removed."""
    scratch = Scratch(docs.sparkSession, "lines")
    firsts = scratch.save(distinct_lines(docs, id_col, text_col), "firsts")
    gone = scratch.save(near_lines(docs, firsts, scratch, id_col, text_col, fuzzy_chars), "gone")
    for done in ("halves", "candidates", "variants"):
        scratch.drop(done)
    docs = docs.drop("n_lines", "n_removed")
    own = "qs"  # no column of the documents begins like the columns of this function
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "x"
    d, m, u, keep, first, lines, left = (f"{own}_{x}" for x in ("d", "m", "u", "keep", "first", "lines", "left"))
    kept = firsts.join(gone, ["h1", "h2"], "left_anti").select(F.col("first.d").alias(d), F.col("first.m").alias(m), F.col("first.p").alias("p"), F.lit(None).cast("bigint").alias(u))
    place, mark = F.monotonically_increasing_id(), F.xxhash64(text_col)
    twice = docs.select(F.col(id_col).alias(d), mark.alias(m), place.alias(u)).groupBy(d, m).agg(F.min(u).alias(u), F.count("*").alias("n")).where("n > 1").select(d, m, F.lit(None).cast("int").alias("p"), u)
    kept = kept.unionByName(twice).groupBy(F.col(d).alias(first), m).agg(F.collect_list("p").alias(keep), F.max(u).alias(f"{u}0"))
    rows = docs.withColumns({f"{m}0": mark, u: place, lines: F.split(F.col(text_col), "\n", -1)})
    rows = rows.join(kept, F.col(id_col).eqNullSafe(F.col(first)) & (F.col(f"{m}0") == F.col(m)), "left")
    always = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: _blank(F.element_at(lines, i + 1)))
    mine = F.col(f"{u}0").isNull() | (F.col(f"{u}0") == F.col(u))
    rows = rows.withColumn(left, F.array_sort(F.array_union(always, F.when(mine & F.col(keep).isNotNull(), F.col(keep)).otherwise(F.array().cast("array<int>")))))
    text = F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")
    size = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines))
    removed = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left))
    out = rows.withColumns({"n_lines": size.cast("long"), "n_removed": removed.cast("long"), text_col: F.when(F.col(text_col).isNotNull(), text)})
    return scratch.keep(out.select(*docs.columns, "n_lines", "n_removed"))


def sql(name: str = "documents", fuzzy_chars: int = FUZZY_CHARS) -> str:
    """DuckDB SQL for doc_id, n_lines, n_removed, text_sha256 of a table with distinct ids."""
    return f"""WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {name}),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM s),
o AS (SELECT *, length(line) AS n, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' AS counts FROM l),
f AS (SELECT line, n, min((doc_id, p)) AS first FROM o WHERE counts GROUP BY line, n),
k AS (SELECT *, unnest([line[1:n // 2], line[n // 2 + 1:], line[1:(n - 1) // 2], line[(n - 1) // 2 + 2:]]) AS half, unnest([0, 1, 0, 1]) AS side, unnest([n, n, n - 1, n - 1]) AS class FROM f WHERE n >= {fuzzy_chars}),
g AS (SELECT DISTINCT a.line FROM k a JOIN k b ON a.half = b.half AND a.side = b.side AND a.class = b.class AND a.line <> b.line AND b.first < a.first WHERE levenshtein(a.line, b.line) <= 1),
x AS (SELECT o.*, NOT counts OR ((o.doc_id, o.p) = f.first AND g.line IS NULL) AS kept FROM o LEFT JOIN f ON o.line = f.line AND o.counts LEFT JOIN g ON o.line = g.line AND o.counts)
SELECT s.doc_id, coalesce(count(x.p), 0) AS n_lines, coalesce(count(*) FILTER (WHERE NOT kept), 0) AS n_removed,
sha256(CASE WHEN text IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE kept), '') END) AS text_sha256
FROM s LEFT JOIN x ON s.doc_id = x.doc_id GROUP BY s.doc_id, s.text"""
