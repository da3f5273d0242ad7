"""Curation profiles with the default medical lexicons."""

from qacorpus.plans import curate

GOOD_Q = "What is the treatment for chest pain and high blood pressure in patients?"
GOOD_A = "The doctor may start a medication because the heart needs treatment. The therapy is recommended for the patient."


def raw(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord bigint, question string, answer string, input string, source string")


ROWS = [
    (GOOD_Q, GOOD_A, None, "s"),
    (GOOD_Q.upper(), GOOD_A, None, "s"),  # same question
    ("What is the weather like in the north today?", "It is a sunny day with a little wind.", None, ""),  # irrelevant
    ("short", "no", None, None),  # incomplete
    ("What is a cure for fever, click here now?", "A fake treatment by a doctor.", None, None),  # offensive
    ("", "Yes", "What is the dose of 5mg medication for MI?", None),  # field fallback
]


def test_funnel_and_standard(spark):
    status = [r["status"] for r in curate.funnel(raw(spark, ROWS)).orderBy("ord").collect()]
    assert status == ["cleaned", "cleaned", "irrelevant", "incomplete", "offensive", "cleaned"]
    out = {r["ord"]: r for r in curate.standard(raw(spark, ROWS), processed_at="2024-01-01 00:00:00").collect()}
    assert sorted(out) == [0, 5]
    assert out[0]["answer"] == "Recommended"  # the whole answer is replaced
    assert out[5]["question"] == "What is the dose of 5mg medication for MI (Myocardial Infarction)?"
    assert (out[5]["answer"], out[5]["source"], out[0]["source"]) == ("Yes", "unified_cleaner", "s")
    assert (out[0]["specialty"], out[0]["language"], out[0]["type"]) == ("cardiology", "english", "medical_qa")


def test_fill_missing_counts(spark):
    df = spark.createDataFrame(
        [("q choose", "a", "x", None), ("q", "", None, None)], "question string, answer string, specialty string, severity_level string"
    )
    rows = curate.fill_missing(df).collect()
    assert (rows[0]["specialty"], rows[0]["severity_level"], rows[0]["type"], rows[0]["filled"]) == ("x", "moderate", "medical_mcq", 4)
    assert (rows[1]["specialty"], rows[1]["filled"]) == (None, 0)


def test_enhanced_keeps_irrelevant_rows(spark):
    out = {r["ord"]: r for r in curate.enhanced(raw(spark, ROWS)).collect()}
    assert sorted(out) == [0, 1, 2, 3, 4, 5]
    assert out[5]["question"].startswith("What is the dose of 5 mg medication")
    assert out[2]["quality_score"] == 0.8 and out[0]["medical_terms_count"] >= 5


def test_thorough(spark):
    near = GOOD_Q.replace("patients?", "patient?")
    rows = [*ROWS, (near, GOOD_A, None, None)]
    strict = curate.thorough(raw(spark, rows), processed_at="2024-01-01 00:00:00").collect()
    # the offensive filter belongs to the standard profile only; best quality first
    assert [r["ord"] for r in strict] == [0, 4]
    loose = curate.thorough(raw(spark, rows), fuzzy=False).collect()
    assert sorted(r["ord"] for r in loose) == [0, 4, 6]
    row = strict[0]
    # the cleaned sentence is re-capitalised and its phrases are rewritten
    assert row["question"] == "What is the treatment for chest pain and high blood pressure in patients?"
    assert row["quality_score"] >= 0.7 and row["specialty"] == "cardiology" and row["validation_passed"]


def test_verdicts(spark):
    stages = curate.thorough_stages(raw(spark, ROWS), fuzzy=False)
    assert {r["verdict"]: r["n"] for r in curate.verdict_counts(stages).collect()} == {"passed": 2}
