"""TXT1-TXT20 with the default profile on hand-written rows."""

from dataclasses import replace

from pyspark.sql import functions as F

from qacorpus.functions import text
from qacorpus.lexicon import MEDICAL


def test_clean_text(values):
    rows = {
        None: "",
        "   ": "",
        "<p>What is <b>MI</b>?</p>": "What is MI?",
        "see http://x.org/a?b=1 now": "see now",
        "mail me@x.org please": "mail please",
        "a@b@ c @d e@ f@g": "c @d e@",
        "pick (a) one(b)two ( c )": "pick (A) one (B) two ( c )",
        "(a)(d)": "(A) (D)",
        "really?!. yes!!": "really. yes!",
        "a 　 b\n\tc": "a b c",
        "<unclosed text": "<unclosed text",
    }
    assert values(text.clean_text, list(rows)) == list(rows.values())


def test_long_word_with_at_sign_is_linear(values):
    word = "x" * 200_000
    assert values(text.clean_text, [word + "@", "@" + word, word + "@y"]) == [word + "@", "@" + word, ""]


def test_expand_abbreviations(values):
    rows = {
        "MI and MI.": "MI (Myocardial Infarction) and MI (Myocardial Infarction).",
        "éMI MIé _MI mi": "éMI MIé _MI mi",
        "HDL-C 5 mg/dL": "HDL-C (High-Density Lipoprotein Cholesterol) 5 mg/dL (milligrams per deciliter)",
        "BMI 31 kg/m² ok": "BMI 31 kg/m² (kilograms per square meter) ok",
        "PTT": "PTT (Partial Thromboplastin Time)",
    }
    assert values(text.expand_abbreviations, list(rows)) == list(rows.values())


def test_normalize_stats(values):
    rows = {
        "p < 0.05": "p-value less than 0.05",
        "p<0.01": "p-value less than 0.01",
        "p >0.05": "p-value greater than 0.05",
        "p = 0.03": "p-value equals 0.03",
        "95% CI": "95 percent confidence interval",
        "CI95%": "95 percent confidence interval",
        "2020-01-02": "2020 to 01-02",
        "5 - 10%": "5 to 10 percent",
        "x-y": "x-y",
    }
    assert values(text.normalize_stats, list(rows)) == list(rows.values())


def test_normalize_answer(values):
    rows = {
        " TRUE ": "Yes", "n": "No", "Unclear": "Uncertain", "not sure": "Unknown",
        "It is NOT recommended.": "Not recommended", "We recommended it": "Recommended", "other": "other", "": "",
    }
    assert values(text.normalize_answer, list(rows)) == list(rows.values())


def test_standardize_units(values):
    rows = {
        "120/80mmHg": "120/80 mmHg", "37 °c": "37°C", "98.6f": "98.6°F", "70KG": "70 kg", "5mg": "5 mg", "10 cm": "10°Cm",
        "3 cups": "3°Cups", "no digits c": "no digits c",
    }
    assert values(text.standardize_units, list(rows)) == list(rows.values())
    strict = {"10 cm": "10 cm", "3 cups": "3 cups", "37 c.": "37°C."}
    assert values(lambda c: text.standardize_units(c, strict=True), list(strict)) == list(strict.values())


def test_fix_grammar(values):
    rows = {
        "hello , world.Next is": "Hello, world. Next is",
        "camelCase HERE": "Camel case here",
        "one. two.  . three": "One. Two.. Three",  # the blank before a full stop goes first
        "": "",
    }
    assert values(text.fix_grammar, list(rows)) == list(rows.values())


def test_enhance_terms_and_fillers(values):
    rows = {
        "High BP after heart attack": "high blood pressure after myocardial infarction",
        "sugar level": "blood glucose level",
        "medsx pills": "medsx medication",
        "ſugar": "blood glucose",  # long s matches s without case
    }
    assert values(text.enhance_terms, list(rows)) == list(rows.values())
    assert values(text.remove_redundant, ["Please note that  x, in summary y", "plain\n text"]) == ["x, y", "plain text"]


def test_polish_and_whole_cleanings(values):
    assert values(text.final_polish, ["wait....", "no end", "", "ok!"]) == ["wait..", "no end.", "", "ok!"]
    assert values(text.comprehensive_clean, [None, "<b>pain</b>  ,high BP.take 5mg!!!"]) == [
        "", "Pain, high blood pressure. Take 5 mg!"
    ]
    out = values(text.comprehensive_clean, ["<b>What</b> is MI ? p<0.05"])
    # "MI ?" keeps its blank before cleaning, the abbreviation is expanded, the sentence is lower-cased
    assert out == ["What is mi (myocardial infarction)? p-value less than 0.05."]
    assert values(text.enhanced_clean, ["<b>MI</b> in summary 5mg"]) == ["MI (Myocardial Infarction) 5 mg"]


def test_language_and_hash(values):
    import hashlib

    assert values(text.detect_language, ["hello", "123 !?", "", None, "โรคเบาหวาน", "aaaaaaaaaaaaaaaaaaaaก"]) == [
        "english", "unknown", "unknown", "unknown", "thai", "english"
    ]
    digest = hashlib.md5(b"a b").hexdigest()
    assert values(text.text_hash, [" A \n b ", "", None]) == [digest, None, None]


def test_small_projections(values, pairs, spark):
    assert values(text.strip_symbols, ["a-b, c! ไทย é"]) == ["ab c! ไทย"]
    # variants are replaced one after the other, also inside text that an earlier one put in
    assert values(text.standardize_synonyms, ["FLU and Diabetes"]) == ["ไข้หวัดใหญ่ใหญ่ and โรคโรคเบาหวาน"]
    assert values(text.title_name, ["heart_attack o'neil x-ray"]) == ["Heart Attack O'Neil X-Ray"]
    assert values(lambda c: text.ngrams(c, 2, 2), ["A b C d", "a", "", None]) == [["a b", "b c"], [], [], []]
    assert values(text.extract_question, ["x คำถาม: why? คำถาม: b", "/ask hi", " plain "]) == ["why?", "hi", "plain"]
    echo = pairs(lambda p, a: text.strip_prompt_echo(a, p), [("Q:", "Q: yes Human:"), ("", "no"), ("Q", "Human:")])
    assert echo == ["yes", "no", ""]
    assert values(lambda c: text.prompt_format(c, "answer"), ["x"]) == ["answer: x"]
    df = spark.createDataFrame([("it is fine",)], "t string")
    assert df.select(text.capitalize(F.col("t"))).first()[0] == "It is fine"


def test_capitals_letter_by_letter(spark):
    """As the SQL has it: a capital is one letter, also that of a sharp s or a ligature."""
    import duckdb

    texts = ["ßein. ßAU", "ŉa", "ﬁx", "ᾳΣ", "aΣ. ΣΣ", "xİ", "ᾈB", "éÀ", "dž"]
    sql = "SELECT upper(s[1]) || lower(s[2:]) FROM (SELECT unnest(?::VARCHAR[]) AS s)"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.capitalize(F.col("t"))).collect()
    assert [r[0] for r in rows] == [r[0] for r in duckdb.execute(sql, [texts]).fetchall()]


def test_sentences_that_begin_with_a_sharp_s(values):
    assert values(text.fix_grammar, ["ein. ßein. ßpf", "ßein"]) == ["Ein. ẞein. ẞpf", "ẞein"]


def test_iota_below_a_vowel_is_part_of_a_word_in_any_case(values):
    profile = replace(MEDICAL, phrases={"to": "towards"}, fillers=(("for",),))
    assert values(lambda c: text.comprehensive_clean(c, profile), ["go to x\u0345to for x\u0345for"]) == ["Go towards x\u0345to x\u0345for."]


def test_comprehensive_clean_keeps_sharp_s(values):
    assert values(text.comprehensive_clean, ["ein wort. ßau und ßein"]) == ["Ein wort. ẞau und ßein."]
