"""Text as column expressions: normal form, intents, referents, regions, phonetic keys. No UDFs.

Patterns are Java regular expressions that RE2 reads the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intents in order of precedence; the first pattern found decides.
INTENTS = (
    ("farewell", r"\b(bye|goodbye|good bye|see you|good night)\b"),
    ("see_question", r"\bwhat do you see\b|\bwhat are you looking at\b|\bwhere are you looking\b|\bdescribe what you see\b|\bwhat can you see\b"),
    ("identity", r"\bwho are you\b|\bwhat are you\b|\byour name\b"),
    ("hear_question", r"\bwhat do you hear\b|\bwhat did you hear\b|\bwhat was that sound\b|\bwhat are you hearing\b"),
    ("look_command", r"\blook\s+(left|right|up|down|center|centre|middle)\b"),
    ("look_at_thing", r"\blook at\b|\blook toward|\bfind the\b|\bwhere is\b|\bwheres\b|\blocate the\b"),
    ("thanks", r"\bthank"),
    ("greeting", r"\b(hi|hello|hey|howdy|greetings)\b"),
    ("yesno_question", r"^(do|does|did|is|are|was|were|can|could|would|will|have|has|should)\b"),
    ("wh_question", r"^(what|where|who|when|why|how)\b"),
)
# Directions a look may take, what it may be at, and the side phrases and letter classes below.
LOOK = r"\blook\s+(left|right|up|down|center|centre|middle)\b"
REFERENT = r"\b(?:look\s+(?:at|toward(?:s)?)|find|locate|where(?:s|\s+is))\s+(?:the\s+|a\s+|an\s+)?(.+?)(?:\s+please)?\s*$"
# Words that select one of several things by place.
SELECTORS = ("leftmost", "rightmost", "topmost", "uppermost", "bottommost", "lowermost", "nearest", "closest", "farthest", "furthest")
SIDE = r"\b(?:on the|at the|in the)\s+(left|right|top|upper|bottom|lower|middle|center)\s*$"
# Pronouns, directions, and the sides that 'the ... one' may name.
PRONOUNS = ("it", "that", "this", "there")
DIRECTIONS = ("left", "right", "up", "down")
ONE_SIDES = ("left", "right", "top", "upper", "bottom", "lower")


def normalize(c: Column) -> Column:
    """Lower case, everything but a-z and white space removed (digits, accents and signs too)."""
    return F.regexp_replace(F.lower(c), r"[^a-z\s]", "")


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words_of(c))


def is_addressed(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a text calls one of the names, given as patterns over normalised text."""
    return normalize(c).rlike("|".join(f"(?:{p})" for p in patterns))


def intent(c: Column) -> Column:
    """One of 12 labels by ordered first match; at most four words otherwise are a statement."""
    norm = normalize(c)
    out = None
    for label, pattern in INTENTS:
        out = F.when(norm.rlike(pattern), label) if out is None else out.when(norm.rlike(pattern), label)
    return F.when(c.isNotNull(), out.when(word_count(norm) <= 4, "statement").otherwise("unknown"))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def look_direction(c: Column) -> Column:
    d = _found(normalize(c), LOOK)
    return F.when(d.isin("centre", "middle"), "center").otherwise(d)


def region(x: Column, y: Column, low: float = 75.0, high: float = 149.0) -> Column:
    """A point's place in words on a 3 by 3 layout: 'upper left', 'left', 'center' ..."""
    side = F.when(x < low, "left").when(x > high, "right").otherwise("")
    level = F.when(y < low, "upper").when(y > high, "lower").otherwise("")
    both = F.trim(F.concat_ws(" ", level, side))
    return F.when(x.isNotNull() & y.isNotNull(), F.when(both == "", "center").otherwise(both))


def thing_key(c: Column) -> Column:
    """A thing's name for matching: article and spaces dropped, a plural s (not ss) removed."""
    bare = F.regexp_replace(F.trim(normalize(c)), r"^(the|a|an)\s+", "")
    single = F.when(bare.rlike(r"(?:^|[^s])s$"), F.regexp_replace(bare, "s$", "")).otherwise(bare)
    return F.replace(single, F.lit(" "), F.lit(""))


def referent(c: Column) -> Column:
    """X of 'look at (the) X', 'find X', 'where is X'; null without one."""
    return F.nullif(F.trim(F.regexp_extract(normalize(c), REFERENT, 1)), F.lit(""))


def spatial_split(c: Column) -> Column:
    """struct(selector, name): 'leftmost windows' -> (leftmost, windows); 'the gate on the left' -> (left, gate)."""
    norm = F.regexp_replace(normalize(c), "^the ", "")
    words = words_of(norm)
    first = F.get(words, F.lit(0))
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    side = _found(norm, SIDE)
    lead = first.isin(*SELECTORS)
    selector = F.when(lead, first).otherwise(side)
    name = F.when(lead, rest).when(side.isNotNull(), F.trim(F.regexp_replace(norm, SIDE, ""))).otherwise(c)
    return F.struct(selector.alias("selector"), name.alias("name"))


def anaphor(c: Column) -> Column:
    """struct(kind, word): pronoun, det (noun) or one (side); nulls for an ordinary referent."""
    w = words_of(normalize(c))
    w0, w1, n = F.get(w, F.lit(0)), F.get(w, F.lit(1)), F.size(w)
    pronoun = w0.isin(*PRONOUNS)
    alone = pronoun & ((n == 1) | ((n == 2) & (w1 == "again")))
    det = pronoun & w0.isin("that", "this") & ~alone
    rest = F.when(w0 == "the", F.slice(w, 2, F.greatest(n - 1, F.lit(0)))).otherwise(w)
    one = ~pronoun & (F.size(rest) == 2) & (F.get(rest, F.lit(1)) == "one") & F.get(rest, F.lit(0)).isin(*ONE_SIDES)
    kind = F.when(alone, "pronoun").when(det, "det").when(one, "one")
    word = F.when(det & ~alone, F.array_join(F.slice(w, 2, F.greatest(n - 1, F.lit(0))), " ")).when(one, F.get(rest, F.lit(0)))
    return F.struct(kind.alias("kind"), word.alias("word"))


def base_name(c: Column) -> Column:
    """A stored name without its selector; null for a bare direction or nothing."""
    s = spatial_split(c)
    return F.when(c.isNull() | (c == "") | normalize(c).isin(*DIRECTIONS), F.lit(None)).otherwise(s["name"])


def prefixes(c: Column) -> Column:
    """All leading word prefixes, the longest first."""
    w = F.split(F.trim(c), r"\s+")
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(w))), lambda n: F.array_join(F.slice(w, 1, n), " "))


# Sound rewrites in order; each applies to the result of those before it.
SOUNDS = (
    (r"^[kgp]n", "n"), (r"^wr", "r"), ("ph", "f"), ("sch", "sk"), ("ck", "k"), ("ch", "x"), ("sh", "x"), ("th", "0"), ("dge", "j"),
    ("gh", ""), ("q", "k"), ("x", "ks"), ("z", "s"), ("c([eiy])", "s$1"), ("c", "k"), ("g([eiy])", "j$1"), ("mb$", "m"),
)
CLASSES = ("bvfd", "pppt")


def phonetic_key(c: Column) -> Column:
    """Coarse sound skeleton of a word; '' for a text without letters."""
    w = F.regexp_replace(F.lower(c), "[^a-z]", "")
    for pattern, to in SOUNDS:
        w = F.regexp_replace(w, pattern, to)
    w = F.translate(w, *CLASSES)
    w = F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, 2, 1 << 30), "[aeiouy]", ""))
    return F.upper(F.regexp_replace(w, r"(.)\1+", "$1"))


def punctuation_split(c: Column) -> Column:
    """struct(lead, core, tail) of a token."""
    p = r"^(\W*)([\s\S]*?)(\W*)$"
    return F.struct(*[F.regexp_extract(c, p, i).alias(n) for i, n in ((1, "lead"), (2, "core"), (3, "tail"))])


def modeled_reading(words: Column, index: Column, alternative: Column) -> Column:
    """Words joined with the one at ``index`` (from 0) replaced, its white space, capital and last signs kept."""

    def token(w: Column, i: Column) -> Column:
        core = F.trim(w)
        lead = F.regexp_extract(w, r"^(\s*)", 1)
        tail = F.when(core != "", F.regexp_extract(core, r"(\W*)$", 1)).otherwise("")
        upper = core.rlike(r"^\p{Lu}")
        alt = F.when(upper, F.concat(F.upper(F.substring(alternative, 1, 1)), F.lower(F.substring(alternative, 2, 1 << 30)))).otherwise(alternative)
        return F.when(i == index, F.concat(lead, alt, tail)).otherwise(w)

    return F.trim(F.array_join(F.transform(words, token), ""))


def trailing_command(c: Column, word: str = "LOOK") -> Column:
    """Direction on a last line 'LOOK: left'; null without one."""
    last = F.element_at(F.split(F.rtrim(c), "\n"), -1)
    return F.nullif(F.lower(F.regexp_extract(last, rf"^\s*{word}:\s*(\w+)\s*$", 1)), F.lit(""))


def prompt_for(label: Column, template: str = "a photo of a {}") -> Column:
    head, _, tail = template.partition("{}")
    return F.concat(F.lit(head), label, F.lit(tail))


def base_path(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]+)/?$", 1)


def config_hash(**values: Column) -> Column:
    """SHA-256 of a JSON object whose keys are sorted."""
    return F.sha2(F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)])), 256)
