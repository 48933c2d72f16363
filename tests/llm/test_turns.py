import random

import numpy as np
import pytest

from chronoloom.llm import turns as T
from tests.conftest import rows

ROSTER = [(1, "Operator"), (2, "Narrator"), (5, "Gallery Guide"), (12, "Sound Desk"), (21, "Late Guest")]
SEG = "run_id bigint, seg_id bigint, start_s double, text string, words array<struct<start:double,end:double,word:string,prob:double>>, speaker_id string, block string"


@pytest.fixture(scope="module")
def roster():
    return T.Roster.of(ROSTER)


@pytest.fixture(scope="module")
def tagger(roster):
    return T.train([], roster)


@pytest.mark.parametrize(
    "label,want",
    [("Operator:", 1), ("opertor", 1), ("S12", 12), ("SPK_02", 2), ("speaker five", 5), ("Speaker 12:", 12), ("<sound_desk>", 12), ("Gallery-Guide. :", 5), ("S3", None), ("note", None), ("", None), ("speaker stack", None), ("speaker twenty-one:", 21), ("Speaker twenty two", None)],
)
def test_labels(roster, label, want):
    assert roster.meant(label) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("**Gallery Guide:** hold on the hm bell", (5, "hold on the bell")), ("[00:00:45] Operator: right um -- so", (1, "right -- so")), (">> SOUND DESK: 0:14 yes", (12, "yes")),
        ("S2: note: the lamp fell", (2, "note: the lamp fell")), ("warning: it moved", (None, "warning: it moved")), ("00:00:01.500 --> 00:00:03.000 Narrator ： [ hum of a fan ] go", (2, "go")),
        ("(Operator) *clears throat* uh-huh", (1, "")), ("♪ Umm...", (None, "")), ("speaker one: 45 seconds in", (1, "45 seconds in")), ("Stranger: hello there", (None, "Stranger: hello there")), ("", (None, "")),
        ("the speaker stack is here", (None, "the speaker stack is here")),
    ],
)
def test_segments_are_read(tagger, roster, text, want):
    assert T.read_segment(text, tagger, roster) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("Operator: (the whole crowd slowly starts to laugh and clap)", (1, "")), ("S2: the gate [ the low hum of a very old fan in the hall ] is here", (2, "the gate is here")),
        ("Narrator: (the lamp is out", (2, "(the lamp is out")),
    ],
)
def test_long_annotations_go(tagger, roster, text, want):
    assert T.read_segment(text, tagger, roster) == want


def test_unclosed_brackets_are_no_group():
    assert T._brackets("( a ( b [ c ]".split()) == [(4, 6, "[")]
    assert T._brackets(["("] * 100_000) == []


def test_viterbi_is_the_best_path(tagger, roster):
    import itertools

    texts = [t.split() for t in ("[00:00] Operator: um go", "", "um", "(Sound Desk) so ♪ then")]
    lexicon = T.Lexicon(roster)
    batch = lexicon.batch(texts)
    scores = tagger.scores(lexicon, batch)
    tags = T.viterbi(scores, batch.begin, tagger.steps)
    for toks, a in zip(texts, batch.begin):
        score = lambda p: sum(scores[a + k, t] for k, t in enumerate(p)) + (tagger.steps[5, p[0]] if len(p) else 0) + sum(tagger.steps[x, y] for x, y in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(5), repeat=len(toks)), key=score)
        assert abs(score(best) - score(tags[a : a + len(toks)].tolist())) < 1e-9


def test_tables_give_the_same_scores_as_spelled_out_features(tagger, roster):
    lexicon = T.Lexicon(roster)
    texts = [[x.translate(T._DIGITS) for x, _ in line] for line in T.composed_lines([["so", "it", "goes"]], roster, 60)]
    batch = lexicon.batch(texts)
    scores = tagger.scores(lexicon, batch)
    names = {}
    numbers = T.feature_numbers(lexicon, batch, names)
    said = {n: x for x, n in names.items()}
    for i in range(len(texts)):
        for k, f in enumerate(T.features(lexicon, batch, i)):
            assert sorted(f) == sorted(said[n] for n in numbers[batch.begin[i] + k] if n >= 0)
            assert scores[batch.begin[i] + k] == pytest.approx(tagger._sum(f))


def held_out(data):
    import duckdb

    full = T.Roster.of(duckdb.sql(f"select speaker_id, display_name from '{data}/speakers.parquet'").fetchall())
    found = duckdb.sql(f"select distinct text, list_transform(words, lambda w: w.word) from '{data}/segments.parquet' where text is not null and words is not null").fetchall()
    own = sorted((t, [w for w in ws if w]) for t, ws in found)
    return full, own[::2], [(T.tokens(t), g) for t, ws in own[1::2] if T.tokens(t) and (g := T.self_label(t, ws, full)) is not None]


def right(tagger, roster, tested):
    tags, begin = tagger.decode(T.Lexicon(roster), [[x.translate(T._DIGITS) for x in t] for t, _ in tested])
    gold = [g for _, own in tested for g in own]
    return np.logical_and.reduceat(tags == gold, begin[:-1]).mean()


def test_weights_and_transitions_decide_held_out_rows(data):
    full, learn, tested = held_out(data)
    tagger = T.train(learn, full)
    assert len(tested) > 50 and right(tagger, full, tested) > 0.99
    first = {"s": 0, "t": 1, "a": 2, "f": 3, "z": 4}
    spoken = [[t for t, k in zip(toks, g) if k == T.SPEECH] for toks, g in tested]
    tested = [([x for x, _ in line], [first[k] for _, k in line]) for line in T.composed_lines([x for x in spoken if x], full, 1500)]
    assert right(tagger, full, tested) > 0.95
    without = lambda keep, steps: right(T.Tagger({k: v for k, v in tagger.weights.items() if keep(k)}, steps), full, tested)
    assert without(lambda k: True, np.zeros_like(tagger.steps)) < right(tagger, full, tested)
    assert without(lambda k: not k.startswith(("-", "+")), tagger.steps) < 0.98
    assert without(lambda k: not k.lstrip("-+").startswith("r="), tagger.steps) < 0.98


def test_reader_forgets_and_goes_on(tagger, roster, monkeypatch):
    monkeypatch.setattr(T.Reader, "MOST", 3)
    reader = T.Reader(tagger, roster)
    for _ in range(3):
        assert reader.read(["Operator: go on", "S12: and so", ""]) == [(1, "go on"), (12, "and so"), (None, "")]


def test_a_long_text_is_read_whole(tagger, roster):
    text = "Operator: " + "so it goes um " * 20_000
    assert T.read_segment(text, tagger, roster) == (1, ("so it goes " * 20_000).strip())


def brute(segs, tagger, roster):
    out = []
    for run in sorted({s[0] for s in segs if s[0] is not None}):
        own = {}
        for r, i, start, text, words, *_ in segs:
            if r != run:
                continue
            if text is None and words is not None:
                text = " ".join(w[2].strip() for w in words if w[2] is not None)
            if start is None and words:
                start = min((w[0] for w in words if w[0] is not None), default=None)
            who, clean = T.read_segment(text or "", tagger, roster)
            if any(c.isalnum() for c in clean):
                own[i] = (float("inf") if start is None else round(start * 1000), i, who)
        now, spans = 0, []
        for _, i, who in sorted(own.values(), key=lambda x: x[:2]):
            now = now if who is None else who
            if spans and spans[-1][3] == now:
                spans[-1][2] = i
            else:
                spans.append([run, i, i, now])
        out += [tuple(s) for s in spans]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [700, 10**7])
def test_turns_against_a_scan(spark, block, roster):
    rng = random.Random(block)
    lines = ["Operator: hello", "S2: yes", "um", "well then", "[music]", "(Sound Desk) one two", "S12: hm", None, "", "go on"]
    segs = []
    for i in range(160):
        words = [(i / 3, i / 3 + 0.1, " so", 0.9)] if rng.random() < 0.3 else None
        segs.append((rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, rng.randrange(0, 60) / 7]), rng.choice(lines), words, "clash", "clash"))
    df = spark.createDataFrame(segs + segs[:30], SEG)
    sp = spark.createDataFrame(ROSTER + ROSTER[:1], "speaker_id bigint, display_name string")
    labelled = T.speaker_turns(df, sp, block_ms=block)
    tagger = T.fit_tagger(df, roster, text="text", words="words", id="seg_id")
    got = rows(T.turn_spans(labelled), "run_id", "first_seg_id", "last_seg_id", "speaker_id")
    assert got == brute(segs, tagger, roster)
    texts = T.turn_texts(labelled).filter("run_id = 2").orderBy("turn_no", "piece_no").collect()
    assert texts and all(t["text"] for t in texts)


def test_empty(spark):
    df, sp = spark.createDataFrame([], SEG), spark.createDataFrame([], "speaker_id bigint, display_name string")
    assert T.turn_spans(T.speaker_turns(df, sp)).count() == 0
    some = spark.createDataFrame([(1, 1, 0.5, "Operator: hello", None, None, None)], SEG)
    assert rows(T.turn_spans(T.speaker_turns(some, sp)), "first_seg_id", "speaker_id") == [(1, 0)]
