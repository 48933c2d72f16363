"""One consistent form for texts that look the same but differ in their characters.

Arrow batches are handed to an in-process DuckDB whose embedded SQL does the work: nfc_normalize
composes accents, one translate maps compatibility forms, spaces and look-alike letters, a regular
expression drops invisible characters, and a second nfc_normalize composes what these steps laid
bare. Case, accents and raised or lowered digits are part of the look and stay.

Look-alike letters come from Unicode's own confusables data (UTS 39) as the session's JVM carries it, by
one stated policy (see look_alikes); which characters are compatibility forms comes from Unicode's
character data.
"""

from __future__ import annotations

import hashlib
import string
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.session import materialise

Alikes = tuple[tuple[str, str], ...]
_ALIKES: list[Alikes] = []


def look_alikes(spark: SparkSession) -> Alikes:
    """(letter, ASCII letter) for every letter that UTS 39 calls confusable with exactly one ASCII letter.

    Policy: single letters only, of any script written from left to right in letters of ordinary width, and
    never of ASCII itself (l, I, 1 and rn, m stay apart). Case is part of the look: a capital stands only for a
    capital, a small letter for a small one; letters without case for either, the small one if both fit.
    """
    if not _ALIKES:
        letters = [c for c in map(chr, range(0x41, 0x20000)) if unicodedata.category(c)[0] == "L"]
        kinds = spark._jvm.com.ibm.icu.text
        checker = kinds.SpoofChecker.Builder().setChecks(kinds.SpoofChecker.CONFUSABLE).build()
        # The line feed is confusable with nothing, so one call answers for all letters.
        looks = checker.getSkeleton("\n".join(letters)).split("\n")
        ascii_of: dict[str, list[str]] = {}
        for c, look in zip(letters, looks):
            if c in string.ascii_letters:
                ascii_of.setdefault(look, []).append(c)
        out = []
        for c, look in zip(letters, looks):
            if c.isascii() or look not in ascii_of or unicodedata.bidirectional(c) != "L" or unicodedata.east_asian_width(c) in "WF":
                continue
            kind = unicodedata.category(c)
            fits = [a for a in ascii_of[look] if kind not in ("Lu", "Lt", "Ll") or a.isupper() == (kind != "Ll")]
            if fits:
                out.append((c, max(fits)))
        _ALIKES.append(tuple(out))
    return _ALIKES[0]


# Compatibility decompositions whose result looks like the character itself.
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
# Blocks whose compatibility characters are drawn as several others side by side: digraphs,
# dots and double marks, Roman numerals, Latin and Armenian ligatures.
SIDE_BY_SIDE = ((0x0132, 0x0149), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0587, 0x0587), (0x2025, 0x2026), (0x203C, 0x203C), (0x2047, 0x2049), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
# Characters without a glyph of their own (RE2 class).
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"


@lru_cache(maxsize=4)
def character_maps(alikes: Alikes) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(same character, look-alike letter, several characters): maps built from Unicode's own data."""
    letters, single, looks, many = dict(alikes), {}, {}, {}
    for code in range(0xA0, 0x20000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or not unicodedata.is_normalized("NFC", c):
            continue
        if unicodedata.category(c) == "Zs":
            single[c] = " "
            continue
        parts = unicodedata.decomposition(c).split()
        if c in letters:
            looks[c] = letters[c]
        elif parts and parts[0] in SAME_LOOK_TAGS:
            to = unicodedata.normalize("NFKC", c)
            if to == c or not to or any(unicodedata.combining(x) or x == " " for x in to):
                continue
            if len(to) == 1:
                single[c] = to
            elif any(a <= code <= b for a, b in SIDE_BY_SIDE):
                many[c] = to
        elif parts and not parts[0].startswith("<"):
            # An accented look-alike: ё is drawn as ë.
            base, *marks = unicodedata.normalize("NFD", c)
            if base in letters:
                to = unicodedata.normalize("NFC", letters[base] + "".join(marks))
                if len(to) == 1:
                    looks[c] = to
    single["‐"] = single["‑"] = "-"
    return single, looks, many


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _class(chars: list[str]) -> str:
    """An RE2 class of sorted characters, neighbours joined to ranges."""
    out: list[list[int]] = []
    for c in map(ord, chars):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


# Where translate's table is cut: Latin, Greek and Cyrillic; the rest of the plane; width forms; the planes above.
_PARTS = (0x530, 0xFF00, 0x10000, 0x110000)


def _when(sql: str, chars: list[str], then: Callable[[str], str]) -> str:
    """``then`` of an expression where it holds any of the characters: translate and replace pay for
    their whole table on every text, a scan does not."""
    return _where(sql, _class(sorted(chars)), then)


def _where(sql: str, kind: str, then: Callable[[str], str]) -> str:
    return f"list_transform([{sql}], lambda x: CASE WHEN regexp_matches(x, {_quoted(kind)}) THEN {then('x')} ELSE x END)[1]"


# Texts without a character from U+0300 on are composed already; later only a mark or a Hangul letter can compose.
_MAY_COMPOSE, _MARKS = r"[\x{300}-\x{10FFFF}]", r"[\p{M}\x{1100}-\x{11FF}]"


def _translate(sql: str, pairs: dict[str, str]) -> str:
    low = 0
    for high in _PARTS:
        shown = sorted(c for c in pairs if low <= ord(c) < high)
        low = high
        if shown:
            sql = _when(sql, shown, lambda x, shown=shown: f"translate({x}, {_quoted(''.join(shown))}, {_quoted(''.join(pairs[c] for c in shown))})")
    return sql


def _form(text: str, single: dict[str, str], many: dict[str, str]) -> str:
    def spelled(x: str) -> str:
        for c in sorted(many):
            x = f"replace({x}, {_quoted(c)}, {_quoted(many[c])})"
        return x

    composed = lambda x: f"nfc_normalize({x})"
    seen = f"regexp_replace({_translate(_where(text, _MAY_COMPOSE, composed), single)}, {_quoted(INVISIBLE)}, '', 'g')"
    return _where(_when(seen, list(many), spelled), _MARKS, composed)


@lru_cache(maxsize=8)
def form_sql(alikes: Alikes, text: str = "text") -> str:
    """The SQL expression of the consistent form of a column; null stays null."""
    single, looks, many = character_maps(alikes)
    letters = dict(alikes)
    shown = lambda to: "".join(letters.get(x, x) for x in to)
    return _form(text, {c: shown(to) for c, to in single.items()} | looks, {c: shown(to) for c, to in many.items()})


@lru_cache(maxsize=8)
def caseless_sql(alikes: Alikes, text: str = "text") -> str:
    """The SQL expression of the consistent form without case: a letter stands for what it or its capital looks like (в as В as B)."""
    single, looks, many = character_maps(alikes)
    lower: dict[str, str] = {}
    for c in sorted(looks, key=lambda c: (c != c.lower(), c)):  # capitals last: theirs is the last word
        low = c.lower() if len(c.lower()) == 1 else c
        lower[low] = looks[c].lower()
    return _translate(f"lower({_form(text, single, many)})", lower)


def connect():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "autoinstall_known_extensions": False})


PIECE_CHARS = 50_000
CALL_CHARS = 1_000_000


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """A long text cut where nothing composes across: before a sign or space if there is one, else a letter.

    Only a run of letters half a piece long is ever cut inside.
    DuckDB holds a copy of a string per step of an expression, so what it gets at once is kept small.
    """
    out, start = [], 0

    def cuts(c: str, letters: bool) -> bool:
        return c in " \n\r\t" or unicodedata.category(c)[0] in ("ZPSLN" if letters else "ZPS") and not "\u1100" <= c <= "\u11ff"

    while len(text) - start > size:
        high, low = start + size, start + size // 2
        at = next((k for k in range(high, low, -1) if cuts(text[k], False)), None)
        at = at or next((k for k in range(high, low, -1) if cuts(text[k], True)), None)
        at = at or next((k for k in range(high, len(text)) if cuts(text[k], True)), len(text))
        out.append(text[start:at])
        start = at
    return [*out, text[start:]] if start < len(text) or not out else out


def mapped(con, texts: list[str | None], sql: str) -> list[str | None]:
    """An SQL expression of ``text`` for every text, run by DuckDB over pieces whose results are put together."""
    parts = [(i, p) for i, t in enumerate(texts) if t is not None for p in (pieces(t) if len(t) > PIECE_CHARS else (t,))]
    got: list[list[str]] = [[] for _ in texts]
    lo = 0
    while lo < len(parts):
        hi, size = lo, 0
        while hi < len(parts) and (hi == lo or size + len(parts[hi][1]) <= CALL_CHARS):
            size += len(parts[hi][1])
            hi += 1
        con.register("batch", pa.table([pa.array(range(lo, hi), pa.int64()), pa.array([p for _, p in parts[lo:hi]], pa.string())], names=["n", "text"]))
        for (i, _), (x,) in zip(parts[lo:hi], con.execute(f"SELECT {sql} FROM batch ORDER BY n").fetchall()):
            got[i].append(x)
        con.unregister("batch")
        lo = hi
    return [None if t is None else g[0] if len(g) == 1 else "".join(g) for t, g in zip(texts, got)]


def _slim(df: DataFrame, id: str, text: str) -> tuple[DataFrame, T.DataType]:
    return df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")), df.schema[id].dataType


def consistent_form(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, form): one row per row of ``df``; a null text has a null form, an empty one an empty form."""
    slim, kind = _slim(df, id, text)
    sql = form_sql(look_alikes(df.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for batch in batches:
            forms = mapped(con, batch.column(1).to_pylist(), sql)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=["id", "form"])

    out = slim.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("form", T.StringType())]))
    return out.withColumnRenamed("id", id)


def look_keys(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, look, exact): MD5 (16 bytes) of the consistent form and of the text; rows without a text are left out.

    The keys are written out once, as both uses of them would otherwise normalise every text again.
    """
    slim, kind = _slim(df.filter(F.col(text).isNotNull()), id, text)
    sql = form_sql(look_alikes(df.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        md5 = lambda x: hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys = [pa.array([md5(x) for x in xs], pa.binary()) for xs in (mapped(con, texts, sql), texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *keys], names=["id", "look", "exact"])

    fields = [T.StructField("id", kind), T.StructField("look", T.BinaryType()), T.StructField("exact", T.BinaryType())]
    return materialise(slim.mapInArrow(run, T.StructType(fields)))


def look_classes(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, class_id, text_id, n_texts, n_links): one row per row with a text.

    class_id is the smallest id of the texts that look the same, text_id the smallest id of those equal to
    this one, n_texts how many different texts the class has and n_links how many rows of the class have
    another text. Every look-alike pair follows: same class_id, other text_id. Null texts are left out; an
    empty table gives no rows.
    """
    keys = look_keys(df, id, text)
    texts = keys.groupBy("look", "exact").agg(F.min("id").alias("text_id"), F.count(F.lit(1)).alias("n"))
    looks = texts.groupBy("look").agg(F.min("text_id").alias("class_id"), F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_rows"))
    told = texts.join(looks, "look").select("look", "exact", "class_id", "text_id", "n_texts", (F.col("n_rows") - F.col("n")).alias("n_links"))
    return keys.join(told, ["look", "exact"]).select(F.col("id").alias(id), "class_id", "text_id", "n_texts", "n_links")


def look_pairs(df: DataFrame, id: str, text: str, names: tuple[str, str] = ("id_a", "id_b")) -> DataFrame:
    """(id_a, id_b), the smaller first: all rows whose texts differ in characters but share their consistent form.

    Rows of looks with a single text never reach the join. Copies pair out in full, so n copies beside d
    variants give n * d rows; look_classes says the same in one row per row. Null texts match nothing; an
    empty table gives no rows.
    """
    keys = look_keys(df, id, text)
    varied = keys.groupBy("look", "exact").agg(F.lit(1)).groupBy("look").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("look")
    rows = keys.join(varied, "look", "left_semi")
    every = rows.alias("r").join(rows.alias("f"), F.expr("r.look = f.look and r.exact < f.exact"))
    return every.select(F.least("r.id", "f.id").alias(names[0]), F.greatest("r.id", "f.id").alias(names[1])).distinct()
