"""Text, fuzzy matching, vectors, hashes and scalar scales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import perception as P
from chronoloom.functions import text as X
from chronoloom.operators import fuzzy, state, vector
from chronoloom.plans.common import r
from chronoloom.session import table


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("text").isNotNull())


def _segs(spark, d) -> DataFrame:
    """One row per segment: late copies collapse."""
    s = table(spark, d, "segments")
    return s.groupBy("run_id", "seg_id").agg(F.max("text").alias("text"), F.max("avg_logprob").alias("avg_logprob"), F.max("words").alias("words"))


def text_normalize(spark, d):
    return _docs(spark, d).select("doc_id", X.normalize(F.col("text")).alias("norm"), X.word_count(X.normalize(F.col("text"))).cast("bigint").alias("n_words"))


def intent_classify(spark, d):
    return _segs(spark, d).select("seg_id", X.intent(F.col("text")).alias("intent"), X.look_direction(F.col("text")).alias("direction"))


def addressed(spark, d):
    return _segs(spark, d).filter(F.col("text").isNotNull()).select("seg_id", X.is_addressed(F.col("text"), (r"operator", r"sound\s*desk", r"lab\s+lead")).alias("called"))


def referent_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", X.referent(F.col("text")).alias("referent"))


def _phrases(spark, d) -> DataFrame:
    """Every part's name in one of six phrases that select by place, and in one of six that point back."""
    p, k = F.col("p_name"), F.col("p_partkey") % 6
    deal = lambda *ways: F.element_at(F.array(*ways), (k + 1).cast("int"))
    name = deal(F.concat(F.lit("leftmost "), p, F.lit("s")), F.concat(F.lit("the "), p, F.lit(" on the left")), p, F.concat(F.lit("The Nearest "), p), F.concat(p, F.lit(" at the top")), F.concat(F.lit("The "), F.upper(p), F.lit("!")))
    says = deal(F.lit("it"), F.lit("That again."), F.concat(F.lit("this "), p), F.lit("the upper one"), F.concat(F.lit("look at "), p), F.concat(F.lit("that "), p, F.lit(" again")))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), says.alias("says"))


def spatial_names(spark, d):
    s = X.spatial_split(F.col("name"))
    return _phrases(spark, d).select("p_partkey", s["selector"].alias("selector"), s["name"].alias("rest"), X.thing_key(s["name"]).alias("key"), X.base_name(F.col("name")).alias("base"))


def anaphors(spark, d):
    a = X.anaphor(F.col("says"))
    return _phrases(spark, d).select("p_partkey", a["kind"].alias("kind"), a["word"].alias("word"))


def segment_names(spark, d):
    """What spatial_names parses, of the text of every segment."""
    s = X.spatial_split(F.col("text"))
    return _segs(spark, d).filter(F.col("text").isNotNull()).select("run_id", "seg_id", s["selector"].alias("selector"), s["name"].alias("rest"), X.thing_key(s["name"]).alias("key"), X.base_name(F.col("text")).alias("base"))


def segment_anaphors(spark, d):
    """What anaphors parses, of the text of every segment."""
    a = X.anaphor(F.col("text"))
    return _segs(spark, d).filter(F.col("text").isNotNull()).select("run_id", "seg_id", a["kind"].alias("kind"), a["word"].alias("word"))


def region_name(spark, d):
    return table(spark, d, "events").select("event_id", X.region((F.col("value") * 10) % 224, F.col("user_id").cast("double")).alias("region"))


def _words(spark, d) -> DataFrame:
    """Distinct words of all documents with how often they occur."""
    w = _docs(spark, d).select(F.explode(X.words_of(X.normalize(F.col("text")))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def phonetic_keys(spark, d):
    return _words(spark, d).select("word", X.phonetic_key(F.col("word")).alias("key"))


def vocab_min_rank(spark, d):
    t = _docs(spark, d).select("doc_id", F.explode(F.split("text", r"\s+")).alias("t")).select(F.concat(F.lit(" "), "t").alias("token"), F.col("doc_id").alias("rank"))
    return fuzzy.vocabulary(t)


def phonetic_candidates(spark, d):
    words = _words(spark, d)
    top = words.agg(F.max("n")).first()[0] or 0
    vocab = words.select("word", (F.lit(top) - F.col("n")).alias("rank"))
    out = fuzzy.candidate_readings(words.select("word", F.lit(0.0).alias("prob")), vocab)
    return out.select("word", "reading", r("score", 4), "tier", "reading_key", F.col("position").cast("bigint").alias("position"))


def doubt_gate(spark, d):
    out = fuzzy.doubtful_words(_segs(spark, d).filter(F.col("words").isNotNull()), id="seg_id", below=-0.5, word_below=0.6)
    return out.select("seg_id", F.col("index").cast("bigint").alias("index"), "word", r("prob", 4), F.col("position").cast("bigint").alias("position"))


def garbage_flag(spark, d):
    """Runs of whose segments at least half are unsure."""
    s = _segs(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("avg_logprob") < -0.6).alias("low"))
    return s.select("run_id", "n", "low", ((F.col("n") > 0) & (F.col("low") >= F.call_function("div", F.col("n") + 1, F.lit(2).cast("bigint")))).alias("garbage"))


def zero_shot_topk(spark, d):
    e = table(spark, d, "embeddings")
    out = vector.zero_shot(e, "vec_id", "embedding", vector.label_centroids(e, "embedding", "label"), k=3)
    return out.select("vec_id", F.col("rank").cast("bigint").alias("rank"), "label", r("score", 5), r("prob", 5))


def unknown_threshold(spark, d):
    e = table(spark, d, "embeddings")
    out = vector.zero_shot(e, "vec_id", "embedding", vector.label_centroids(e, "embedding", "label"), k=1, temperature=0.1, unknown_below=0.9)
    return out.select("vec_id", "label", r("prob", 5))


def label_agg(spark, d):
    e = table(spark, d, "embeddings")
    return vector.mean_scores(e, "embedding", vector.label_centroids(e, "embedding", "label")).select("label", r("mean_score", 5))


def centroid_cosine(spark, d):
    """Cosine of each vector to its own label's centroid, in the JVM."""
    e = table(spark, d, "embeddings")
    j = e.join(vector.label_centroids(e, "embedding", "label"), "label")
    return j.select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("centroid")), 5).alias("cos"))


def json_props(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def config_hash(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", X.config_hash(type=F.col("event_type"), k=k).alias("hash"))


def artifact_names(spark, d):
    return table(spark, d, "run_report").filter("video is not null").select("run_id", X.base_path(F.concat(F.lit("/media/in/"), "video")).alias("file")).distinct()


def dialogue_last_region(spark, d):
    turns = _segs(spark, d).select("run_id", "seg_id", X.look_direction(F.regexp_replace("text", "to the ", "")).alias("region"))
    return state.last_region(turns, ["run_id"], "seg_id", "region").select("seg_id", F.col("before").alias("region_before"))


def recent_turns(spark, d):
    return state.recent(_segs(spark, d).select("run_id", "seg_id"), ["run_id"], ["seg_id"], 10)


def prefix_resolution(spark, d):
    says = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.col("p_name"), F.lit("the end")).alias("said"))
    known = table(spark, d, "part").filter("p_size > 10").select(X.thing_key(F.col("p_name")).alias("thing"))
    return state.resolve_prefix(says, "p_partkey", "said", known, "thing")


def perception_scales(spark, d):
    v, u = F.col("value"), F.col("user_id").cast("double")
    out = {
        "saccade": P.saccade_ms(v), "dark": P.darkness_gain(v / 10_000), "aged": P.ageing(v, 50.0), "blob": P.blob(v / 100, u / 100, 8.0), "loud": P.loudness_of_db(-v),
        "hz": P.bin_center_hz(F.col("user_id") % 64), "pan": P.pan_of_levels(v + 1, u + 1), "sure": P.pan_confidence(v / 1e5, u / 1e6), "map_x": P.pan_to_column(v / 100 - 1),
        "deg": P.degrees(v, u, 0.05),
    }
    return table(spark, d, "events").select("event_id", *[F.round(c + F.lit(1e-9), 5).alias(n) for n, c in out.items()], P.flicker_phase(v * 10, 240.0, 80.0).alias("phase"))


_ALL = (
    text_normalize, intent_classify, addressed, referent_extract, spatial_names, anaphors, segment_names, segment_anaphors, region_name, phonetic_keys, vocab_min_rank, phonetic_candidates, doubt_gate, garbage_flag,
    zero_shot_topk, unknown_threshold, label_agg, centroid_cosine, json_props, config_hash, artifact_names, dialogue_last_region, recent_turns, prefix_resolution, perception_scales,
)
QUERIES = {f.__name__: f for f in _ALL}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _norm(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z\\s]', '', 'g')"


def _count(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"


_SEG = "seg as (select run_id, seg_id, max(text) as text, max(avg_logprob) as avg_logprob, max(words) as words from segments group by 1, 2)"
# The SQL says what the patterns mean in its own words: phrases between blanks, first words, rewrites spelled 'this=that'.
_PHRASES = {
    "farewell": "bye/goodbye/good bye/see you/good night",
    "see_question": "what do you see/what are you looking at/where are you looking/describe what you see/what can you see",
    "identity": "who are you/what are you/your name",
    "hear_question": "what do you hear/what did you hear/what was that sound/what are you hearing",
    "look_command": "",
    "look_at_thing": "look at/look toward*/find the*/where is*/wheres*/locate the*",
    "thanks": "thank*",
    "greeting": "hi/hello/hey/howdy/greetings",
}
_FIRST = {"yesno_question": "do does did is are was were can could would will have has should", "wh_question": "what where who when why how"}
_REWRITES = r"^[kgp]n=n ^wr=r ph=f sch=sk ck=k ch=x sh=x th=0 dge=j gh= q=k x=ks z=s c([eiy])=s\1 c=k g([eiy])=j\1 mb$=m"
_TURN = r"\blook\s+(left|right|up|down|center|centre|middle)\b"
_LOOK = f"nullif(regexp_extract({_norm('text')}, '{_TURN}', 1), '')"
_FIND = r"\b(?:look\s+(?:at|towards?)|find|locate|wheres|where\s+is)\s+(?:(?:the|a|an)\s+)?(.+?)(?:\s+please)?\s*$"
_PLACED = r"\b(?:on the|at the|in the)\s+(left|right|top|upper|bottom|lower|middle|center)\s*$"
_LEADS = "('leftmost', 'rightmost', 'topmost', 'uppermost', 'bottommost', 'lowermost', 'nearest', 'closest', 'farthest', 'furthest')"
_SPLIT = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


def _direction(c: str) -> str:
    return f"case when {c} in ('centre', 'middle') then 'center' else {c} end"


def _intent() -> str:
    blank = "' ' || regexp_replace(n, '\\s', ' ', 'g') || ' '"
    arms = []
    for label, phrases in _PHRASES.items():
        tests = [f"contains({blank}, ' {x[:-1]}')" if x.endswith("*") else f"contains({blank}, ' {x} ')" for x in phrases.split("/") if x]
        arms.append(f"when {' or '.join(tests) or f'regexp_matches(n, {_q(_TURN)})'} then '{label}'")
    arms += [f"when string_split(regexp_replace(n, '\\s', ' ', 'g'), ' ')[1] in ({', '.join(map(_q, words.split()))}) then '{label}'" for label, words in _FIRST.items()]
    return f"case when n is null then null {' '.join(arms)} when {_count('n')} <= 4 then 'statement' else 'unknown' end"


def _key(c: str) -> str:
    w = f"regexp_replace(lower({c}), '[^a-z]', '', 'g')"
    for rule in _REWRITES.split():
        p, to = rule.split("=")
        w = f"regexp_replace({w}, {_q(p)}, {_q(to)}, 'g')"
    w = f"translate({w}, 'bvfd', 'pppt')"
    w = f"list_transform([{w}], lambda k: k[1:1] || regexp_replace(k[2:], '[aeiouy]', '', 'g'))[1]"
    for c1 in "0abcdefghijklmnopqrstuvwxyz":
        w = f"regexp_replace({w}, '{c1}{c1}+', '{c1}', 'g')"
    return f"upper({w})"


def _names_sql() -> str:
    bare = f"regexp_replace(trim({_norm('rest')}), '^(the|a|an)\\s+', '')"
    return (
        f"with {_SEG}, a as (select run_id, seg_id, text, {_norm('text')} as full_norm, regexp_replace({_norm('text')}, '^the ', '') as n from seg where text is not null), "
        f"b as (select *, {_SPLIT.format('n')} as w, nullif(regexp_extract(n, {_q(_PLACED)}, 1), '') as side from a), "
        f"c as (select *, case when w[1] in {_LEADS} then w[1] else side end as selector, case when w[1] in {_LEADS} then array_to_string(w[2:], ' ') when side is not null then trim(regexp_replace(n, {_q(_PLACED)}, '')) else text end as rest from b), "
        f"d as (select *, {bare} as k from c) select run_id, seg_id, selector, rest, replace(case when regexp_matches(k, '(^|[^s])s$') then k[:-2] else k end, ' ', '') as key, "
        "case when text <> '' and full_norm not in ('left', 'right', 'up', 'down') then rest end as base from d"
    )


def _anaphors_sql() -> str:
    pro = "('it', 'that', 'this', 'there')"
    return (
        f"with {_SEG}, a as (select run_id, seg_id, {_SPLIT.format(_norm('text'))} as w from seg where text is not null), b as (select *, case when w[1] = 'the' then w[2:] else w end as t, "
        f"w[1] in {pro} and (len(w) = 1 or len(w) = 2 and w[2] = 'again') as alone from a), c as (select *, coalesce(not alone and w[1] in ('that', 'this'), false) as det, "
        f"coalesce(w[1] not in {pro} and len(t) = 2 and t[2] = 'one' and t[1] in ('left', 'right', 'top', 'upper', 'bottom', 'lower'), false) as one from b) "
        "select run_id, seg_id, case when alone then 'pronoun' when det then 'det' when one then 'one' end as kind, case when det then array_to_string(w[2:], ' ') when one then t[1] end as word from c"
    )


_WORDS = f"words as (select word, count(*) as n from (select unnest(list_filter(regexp_split_to_array({_norm('text')}, '\\s+'), lambda w: w <> '')) as word from documents where text is not null) group by 1)"
_VEC = "d as (select label, unnest(generate_series(1, 64)) as i, unnest(embedding) as x from embeddings), m as (select label, i, avg(cast(x as double)) as x from d group by 1, 2), c as (select label, list(x order by i) as c from m group by 1)"
_SCORES = f"{_VEC}, s as (select vec_id, c.label, list_cosine_similarity(cast(embedding as double[]), c.c) as score from embeddings e cross join c)"

SQL = {
    "text_normalize": f"select doc_id, {_norm('text')} as norm, {_count(_norm('text'))} as n_words from documents where text is not null",
    "intent_classify": f"with {_SEG}, t as (select seg_id, {_norm('text')} as n, {_LOOK} as l from seg) select seg_id, {_intent()} as intent, {_direction('l')} as direction from t",
    "addressed": f"with {_SEG} select seg_id, regexp_matches({_norm('text')}, '(operator)|(sound\\s*desk)|(lab\\s+lead)') as called from seg where text is not null",
    "referent_extract": f"select doc_id, nullif(trim(regexp_extract({_norm('text')}, {_q(_FIND)}, 1)), '') as referent from documents",
    # What each phrase was made to say, not how it is parsed.
    "spatial_names": "with p as (select p_partkey, p_partkey % 6 as k, p_name as p from part), n as (select p_partkey, case k when 0 then 'leftmost' when 1 then 'left' when 3 then 'nearest' when 4 then 'top' end as selector, "
    "case k when 0 then p || 's' when 5 then 'The ' || upper(p) || '!' else p end as rest, p, k from p) select p_partkey, selector, rest, "
    "case when k <> 0 and p like '%s' and p not like '%ss' then replace(p[:-2], ' ', '') else replace(p, ' ', '') end as key, rest as base from n",
    "anaphors": "select p_partkey, case p_partkey % 6 when 0 then 'pronoun' when 1 then 'pronoun' when 2 then 'det' when 3 then 'one' when 5 then 'det' end as kind, case p_partkey % 6 when 2 then p_name when 3 then 'upper' when 5 then p_name || ' again' end as word from part",
    "segment_names": _names_sql(),
    "segment_anaphors": _anaphors_sql(),
    "region_name": "with p as (select event_id, fmod(value * 10, 224) as x, user_id as y from events), q as (select event_id, trim((case when y < 75 then 'upper' when y > 149 then 'lower' else '' end) || ' ' || (case when x < 75 then 'left' when x > 149 then 'right' else '' end)) as t from p) "
    "select event_id, case when t = '' then 'center' else t end as region from q",
    "phonetic_keys": f"with {_WORDS} select word, {_key('word')} as key from words",
    "vocab_min_rank": "with t as (select doc_id, unnest(regexp_split_to_array(text, '\\s+')) as t from documents where text is not null) select lower(t) as word, min(doc_id) as rank from t where regexp_full_match(t, '[A-Za-z]{2,}') group by 1",
    "phonetic_candidates": f"with {_WORDS}, v as materialized (select word, (select max(n) from words) - n as rank, {_key('word')} as key from words), k as materialized (select distinct key from v where key <> ''), "
    "near as materialized (select a.key, b.key as near from k a join k b on abs(len(a.key) - len(b.key)) <= 1 and a.key <> b.key and levenshtein(a.key, b.key) = 1), "
    "x as (select a.word, b.word as reading, b.rank, 'exact' as tier, 1.0 as sim, b.key as reading_key from v a join v b on a.key = b.key and a.key <> '' union all select a.word, b.word, b.rank, 'near', 0.5, b.key from v a join near on a.key = near.key join v b on b.key = near.near), "
    "y as (select *, sim * (0.5 + 0.5 * (1 - rank / (select max(rank) from v))) as raw from x where word <> reading), z as (select *, row_number() over (partition by word order by raw desc, reading) as position from y) "
    "select word, reading, round(raw + 1e-12, 4) as score, tier, reading_key, position from z where position <= 5",
    "doubt_gate": f"with {_SEG}, w as (select seg_id, unnest(range(len(words))) as index, unnest(words) as w from seg where words is not null and avg_logprob < -0.5), x as (select seg_id, index, w.word as word, w.prob as prob from w where w.prob < 0.6 and regexp_matches(w.word, '[A-Za-z]')) "
    "select seg_id, index, word, round(prob, 4) as prob, row_number() over (partition by seg_id order by prob, index) as position from x qualify position <= 3",
    "garbage_flag": f"with {_SEG} select run_id, count(*) as n, count(*) filter (avg_logprob < -0.6) as low, count(*) filter (avg_logprob < -0.6) >= (count(*) + 1) // 2 as garbage from seg group by 1",
    "zero_shot_topk": f"with {_SCORES}, p as (select *, exp(score) / sum(exp(score)) over (partition by vec_id) as prob, row_number() over (partition by vec_id order by score desc, label) as rank from s) select vec_id, rank, label, round(score, 5) as score, round(prob, 5) as prob from p where rank <= 3",
    "unknown_threshold": f"with {_SCORES}, p as (select *, exp(score / 0.1) / sum(exp(score / 0.1)) over (partition by vec_id) as prob, row_number() over (partition by vec_id order by score desc, label) as rank from s) select vec_id, case when prob >= 0.9 then label end as label, round(prob, 5) as prob from p where rank = 1",
    "label_agg": f"with {_SCORES} select label, round(avg(score), 5) as mean_score from s group by 1",
    "centroid_cosine": f"with {_VEC} select vec_id, round(list_cosine_similarity(cast(embedding as double[]), c.c), 5) as cos from embeddings join c using (label)",
    "json_props": "select event_type, cast(sum(cast(props->>'$.k' as bigint)) as bigint) as k_sum, max(cast(props->>'$.k' as bigint)) as k_max from events group by 1",
    "config_hash": "select event_id, sha256('{\"k\":' || (props->>'$.k') || ',\"type\":\"' || event_type || '\"}') as hash from events",
    "artifact_names": "select distinct run_id, video as file from run_report where video is not null",
    "dialogue_last_region": f"with {_SEG}, t as (select run_id, seg_id, nullif(regexp_extract({_norm(chr(39).join(['regexp_replace(text, ', 'to the ', ', ', '', ', ', 'g', ')']))}, {_q(_TURN)}, 1), '') as l from seg) "
    f"select seg_id, last_value({_direction('l')} ignore nulls) over (partition by run_id order by seg_id rows between unbounded preceding and 1 preceding) as region_before from t",
    "recent_turns": f"with {_SEG} select run_id, seg_id from seg qualify row_number() over (partition by run_id order by seg_id desc) <= 10",
    "prefix_resolution": "select p_partkey, case when p_size > 10 or k in (select k from (select replace(regexp_replace(lower(p_name), '[^a-z\\s]', '', 'g'), ' ', '') as k from part where p_size > 10)) then m end as matched from "
    "(select p_partkey, p_size, p_name as m, replace(regexp_replace(lower(p_name), '[^a-z\\s]', '', 'g'), ' ', '') as k from part)",
    "perception_scales": "select event_id, round(21 + 2.2 * value + 1e-9, 5) as saccade, round(1 + 2 * greatest(0, least(1, (0.03 - value / 10000) / 0.03)) + 1e-9, 5) as dark, round(exp(-value / 50) + 1e-9, 5) as aged, round(exp(-((value / 100) ** 2 + (user_id / 100.0) ** 2) / 128) + 1e-9, 5) as blob, "
    "round(greatest(0, least(1, (80 - value) / 80)) + 1e-9, 5) as loud, round(50 * pow(160.0, (user_id % 64 + 0.5) / 64) + 1e-9, 5) as hz, round(-greatest(-1, least(1, 10 * log10((value + 1 + 1e-12) / (user_id + 1 + 1e-12)) / 12)) + 1e-9, 5) as pan, "
    "round(greatest(0, least(1, (10 * log10(greatest(value / 1e5, user_id / 1e6) + 1e-12) + 60) / 20)) + 1e-9, 5) as sure, round((0.5 + 0.4 * greatest(-1, least(1, value / 100 - 1))) * 56 + 1e-9, 5) as map_x, round(sqrt(value ** 2 + user_id ** 2) * 0.05 + 1e-9, 5) as deg, "
    "case when fmod(value * 10, 640) < 240 then 'A' when fmod(value * 10, 640) < 320 then 'blank' when fmod(value * 10, 640) < 560 then 'B' else 'blank' end as phase from events",
}
