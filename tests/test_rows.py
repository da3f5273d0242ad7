"""Predicates, classifiers, scores and features with the default profile."""

import math

import pytest
from pyspark.sql import functions as F

from qacorpus.functions import classify, features, predicates, score
from qacorpus.lexicon import DISEASE_LABELS


def test_complete(pairs):
    rows = [("What is flu?", "yes"), ("What", "yes"), ("Tell me about it", "yes"), (None, "x"), ("which one is it", "ab"), ("  what now  ", " abc ")]
    assert pairs(predicates.is_complete, rows) == [True, False, False, False, False, False]
    rows = [
        ("What is the flu virus?", "it is a virus"), ("What is the flu virus?", "I don't know"), ("what what what what", "it is a"),
        ("Is this a long question", "it is it is"),
    ]
    assert pairs(predicates.is_complete_thorough, rows) == [True, False, False, False]


def test_relevance(values):
    low = ["chest pain and fever", "the weather", "a 5 mg dose", "the ear", ""]
    assert values(predicates.is_relevant, low) == [True, False, True, True, False]
    # pain 2 + chest pain 2 + fever 3 (condition) + fever 2 (symptom); "pe" is no abbreviation hit here, "er" of fever is
    got = values(predicates.relevance_weighted, ["chest pain and fever"])[0]
    assert got == 2 + 2 + 3 + 2 + 2 * sum(a in "chest pain and fever" for a in _abbreviations())
    assert values(predicates.relevance_detailed, ["fever in a patient"]) == [2 + 1 + 3]


def _abbreviations():
    from qacorpus.lexicon import ABBREVIATIONS

    return [a.lower() for a in ABBREVIATIONS]


def test_offensive_and_emergency(values):
    assert values(predicates.is_offensive, ["click here", "clicks here", "adulthood", "an adult"]) == [True, False, False, True]
    assert values(predicates.mentions_emergency, ["call 911", "nothing"]) == [True, False]


def test_validity(spark):
    rows = [(20, 20, 0.7, 0.5, 2), (14, 20, 0.7, 0.5, 2), (20, 20, 0.0, 0.5, 2), (20, 20, 0.7, 0.4, 2), (900, 20, 0.9, 0.9, 3)]
    df = spark.createDataFrame([("q" * q, "a" * a, x, c, t) for q, a, x, c, t in rows], "q string, a string, s double, c double, t int")
    got = df.select(
        predicates.valid_thorough(F.col("q"), F.col("a"), F.col("s"), F.col("c"), F.col("t")).alias("v"),
        predicates.valid_combined(F.col("q"), F.col("a"), F.col("s")).alias("w"),
        predicates.final_verdict(F.col("q"), F.col("a"), F.col("s"), F.lit("pain")).alias("x"),
        predicates.final_verdict(F.col("q"), F.col("a"), F.lit(0.9), F.lit("none")).alias("y"),
    ).collect()
    assert [r["v"] for r in got] == [True, False, False, False, True]
    assert [r["w"] for r in got] == [True, True, False, True, True]
    assert [r["x"] for r in got] == ["passed", "passed", "failed_quality", "passed", "failed_length"]
    assert got[0]["y"] == "failed_medical"


def test_classifiers(values):
    assert values(classify.severity, ["a mild stroke", "acute", "routine", ""]) == ["critical", "high", "low", "moderate"]
    assert values(classify.specialty, ["stroke of the heart", "asthma", "x"]) == ["cardiology", "pulmonology", "general_medicine"]
    assert values(classify.qa_type, ["choose one", "(b) it", "why"]) == ["medical_mcq", "medical_mcq", "medical_qa"]
    # one hit each: the first listed wins; two hits beat one
    assert values(classify.keyword_argmax, ["fever and asthma", "stroke", "asthma cough fever", "zzz"]) == [
        "Infection", "Cardiovascular", "Respiratory", "Other"
    ]
    assert values(classify.disease_specialty, ["pneumonia", "gout", "zzz"]) == ["Infectious", "Musculoskeletal", "General Medicine"]
    assert values(classify.route_question, ["เบาหวาน", "heart emergency", "zzz"]) == ["diabetes", "cardiology", "general"]


def test_confidence(spark):
    df = spark.createDataFrame([(math.log(0.9),), (math.log(0.5),), (math.log(0.1),), (1.0,)], "s double")
    conf = classify.confidence(F.col("s"))
    rows = df.select(conf.alias("c"), classify.confidence_level(conf).alias("l")).collect()
    assert [round(r["c"], 6) for r in rows] == [90.0, 50.0, 10.0, 100.0]
    assert [r["l"] for r in rows] == ["HIGH", "MODERATE", "LOW", "HIGH"]


@pytest.mark.parametrize(
    "question,kind",
    [
        ("I have chest pain and my arm pain is bad", "heart_attack"),
        ("crushing chest pain", "heart_attack"),
        ("chest pain only", None),
        ("numbness and weakness on one side", "stroke"),
        ("numbness and weakness", None),
        ("anaphylaxis", "severe_allergic_reaction"),
        ("severe headache stiff neck fever", "meningitis"),
        ("heavy bleeding that won't stop", "severe_bleeding"),
        ("severe bleeding with chest pain and nausea", "heart_attack"),  # two rules: the first wins
    ],
)
def test_alert_rules(values, question, kind):
    assert values(classify.emergency_rule, [question]) == [kind]


def test_alert_answer_and_triage(values):
    from qacorpus.lexicon import ALERT_MESSAGES

    messages = list(ALERT_MESSAGES.values())
    assert values(classify.emergency_answer, messages + ["fine", "EMERGENCY: burns"]) == [
        "⚠️ HEART ATTACK", "⚠️ STROKE", "⚠️ SEVERE ALLERGIC REACTION", "⚠️ MENINGITIS", "⚠️ SEVERE BLEEDING", None, "MEDICAL EMERGENCY"
    ]

    def action(c):
        return classify.triage_action(classify.triage_severity(c), classify.triage_category(c))

    assert values(action, ["severe rash", "constant wheezing", "constant rash", "a rash"]) == [
        "notify_doctor", "notify_doctor", "monitor", "save_to_db"
    ]


def test_scores(pairs, values):
    q, a = "What is the treatment of flu?", "Rest, because it helps. " * 3
    assert pairs(score.quality_basic, [(q, a), ("", ""), ("hi", None)])[0] == pytest.approx(1.0)
    assert pairs(score.quality_basic, [("", "")]) == [0.0]
    assert values(score.term_count, ["chest pain fever", "none"]) == [4, 0]
    # 20 length + 20 terms (4) + 10 + 10 + 10 + 0 advice + 6 overlap (is, a)
    answer = "It is a disease with treatment by a doctor for the patient."
    assert pairs(score.answer_quality_100, [("is a", answer), ("x", "Error")]) == [76, 10]
    assert pairs(lambda x, y: score.exact_match(x, y), [(" A ", "a"), ("a", "b"), (None, "a")]) == [True, False, False]
    assert values(score.answer_confidence, ["a b c", "a b c d e", "a b c d โรค ยา อาการ รักษา"]) == pytest.approx([0.3, 0.6, 0.9])


def test_response_quality(spark):
    rows = [
        ("Call 911 immediately, go to the hospital, this is urgent and an emergency for sure.", "Emergency", 0.2 + 0.3 + 0.2),
        ("Healthy diet, exercise and lifestyle prevent disease in most people of any age.", "Preventive Care", 0.2 + 2 / 11 + 0.3 + 0.2),
        ("short", "Basic", 0.2),
    ]
    df = spark.createDataFrame([(r, c) for r, c, _ in rows], "r string, c string")
    got = [x[0] for x in df.select(score.response_quality_1(F.col("r"), F.col("c"))).collect()]
    assert got == pytest.approx([e for _, _, e in rows])


def test_selection_score(spark):
    df = spark.createDataFrame(
        [("one two three four five six seven eight nine MI", "few words", "cardiology", "critical", "advice"),
         ("q", "a b c d e", None, None, None)],
        "q string, a string, s string, v string, t string",
    )
    got = df.select(score.selection_details(*[F.col(c) for c in "qasvt"]).alias("d")).select("d.*").collect()
    assert got[0]["score"] == pytest.approx(1.2 * 1.3 * 0.9 * 1.1 * 1.05 * 0.7)
    assert got[1]["score"] == pytest.approx(0.7 * 0.9)


def test_features(pairs, values):
    f = pairs(features.qa_features, [("What dose of 5 mg", "urgent 1 2")])[0]
    assert (f["q_word_count"], f["a_word_count"], f["qa_length_ratio"], f["is_what_question"]) == (5, 3, 0.6, 1)
    assert (f["q_number_count"], f["a_number_count"], f["urgency_score"], f["q_bigrams"][0]) == (1, 2, 1, "what dose")
    assert pairs(features.qa_features, [("mild sever", "e pain")])[0]["urgency_score"] == 1  # joined without a blank
    t = values(features.text_features, ["What is MI? One. . two 22", "", None])
    assert (t[0]["sentence_count"], t[0]["word_count"], t[0]["abbreviation_count"], t[0]["starts_with_wh"]) == (2, 7, 1, 1)
    assert t[0]["avg_word_length"] == pytest.approx(sum(map(len, "What is MI? One. . two 22".split())) / 7)
    assert t[1]["word_count"] == t[2]["word_count"] == 0 and t[1]["avg_word_length"] == 0
    assert values(features.question_variations, ["What is flu?", "How to rest", "please?", "what is x"]) == [
        ["What is flu, please?", "Can you explain what is flu?"], ["What is the best way to rest"], [], ["what is x"]
    ]
    assert len(DISEASE_LABELS) == 120
    assert values(features.disease_label, ["lung cancer or cancer", "influenza", "flux", "heart attacks"]) == [
        "lung cancer", "influenza", None, None
    ]
