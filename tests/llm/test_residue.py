import pytest
from pyspark.sql import functions as F

from loomtrace.llm import residue as R

SCHEMA = "test_id string, test_steps array<string>, expected_result string, test_data string"
GOOD = ["Open the start page", "Sign in as kiosk visitor and open the journal view", "Set 12 pages for the weekly invoice and confirm", "The total matches the ledger and the invoice keeps its date"]
RESIDUE = [
    "{{field}}", "Enter {{ screen }} and press the save button", "Sign in as %threshold% and open the list", "[insert amount here]", "The page shows ${user_name} to the user", "Send a request with «role» set", "____",
    "The manifest ends in state [[status]]", "TODO", "TODO: write this step", "TBD / clarify input", "lorem ipsum dolor sit amet, consectetur adipiscing elit", "foo xxx bar", "Enter your data here", "[value]", "...",
    "n/a - fill in later", "Sorry, the journal editor is currently overloaded. Retry in 5 seconds.", "502 Bad Gateway", "<html><head><title>404 Not Found</title></head><body><h1>404 Not Found</h1></body></html>",
    '{"error": {"code": 429, "message": "Too Many Requests"}}', '{"input": "{\\"error\\": {\\"code\\": 403, \\"message\\": \\"Forbidden\\"}}", "rows": 38}', "An unexpected error occurred while processing your request. Reference: 9f3b", "Please enable JavaScript to view this page.", "<noscript>Turn on JS to use this application</noscript>",
    "Your browser does not run scripts or they are blocked; the content cannot be shown.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "The form is saved. Describe the expected outcome of this step",
]
CONTENT = [
    "Enter {{7*7}} in the profile name and save the form", "Type ${3*2} into the note and submit", "Leave the [optional] remark of the quota blank", "Paste <b>bold</b> into the comment box and press send", "Set the label of the quota to TODO and open the task board",
    "Open an address under /items/{id} with id replaced by 11 and watch the reply", "The preview of the mail template lists its fields {name} and {date} for editing", "Turn off JavaScript in the browser and reload the start page",
    "A notice asks the user to enable JavaScript and the static menu still works", "The error page shows reference number and no stack trace for the grant request", "Status 403 is returned and the price band stays unchanged",
    "The user is told that the session has expired and the calendar is kept as draft", "The journal view displays 'To be defined' for the tax rate without owner until one is set", "Fill the description with a lorem ipsum paragraph of 2000 characters to reach the size limit",
    '{"payload": "{{7*7}}", "field": "nickname"}', '{"javascript": false, "browser": "any"}', '{"pattern": "%s of %s", "rows": 27}', '{"note": "TODO list", "size": 32}', '{"status": 503, "retry_after": 18}', *GOOD,
]


def test_labelled(spark):
    """Every line once among ordinary content, whose words give the weights."""
    rows = [(f"r{i}", [t], None, None) for i, t in enumerate(RESIDUE)] + [(f"c{i}", [t], None, None) for i, t in enumerate(CONTENT)] + [(f"g{i}", GOOD[:3], GOOD[3], None) for i in range(200)]
    got = {r["test_id"] for r in R.residue_fields(spark.createDataFrame(rows, SCHEMA)).collect()}
    missed, wrong = [RESIDUE[i] for i in range(len(RESIDUE)) if f"r{i}" not in got], [CONTENT[i] for i in range(len(CONTENT)) if f"c{i}" in got]
    assert not missed and not wrong


def test_fields_and_clean(spark):
    long = "The list is unchanged. " * 20_000
    rows = [("a", ["ok step one", "{{name}}", None], None, None), ("a", ["Open the start page"], long, "{}"), ("b", None, "TODO", '{"x": ["TBD", {"y": null}], "TODO": 1}'), ("c", [], "", " "), ("d", None, None, '{"TODO": "fine"}'),
            (None, ["{{x}}"], None, None), ("e", ["Open the start page", ""], None, "not {json")]
    df = spark.createDataFrame([*rows, rows[0]], SCHEMA).withColumn("text", F.lit("clash")).withColumn("field_name", F.lit("clash"))
    assert {tuple(r) for r in R.residue_fields(df).collect()} == {("a", "test_steps"), ("b", "expected_result"), ("b", "test_data"), (None, "test_steps")}
    clean = R.clean_tests(df)
    assert sorted(r["test_id"] for r in clean.collect()) == ["a", "c", "d", "e"] and clean.columns == df.columns
    assert R.residue_fields(df.where("1 = 0")).count() == 0 and R.clean_tests(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize(("text", "words"), [("{{ a b }} x", ["⌂", "x"]), ("{a} 12 JS", ["a", "0", "js"]), ("turn on client-side scripts", ["enable", "js"]), ("[step]", ["⊏"]), ("…", ["…"]), ("<p>x</p>", ["x"])])
def test_words(text, words):
    assert R.words_of(text) == words


def test_passages():
    assert sorted(R.passages_of('{"a": ["x", {"b": "[\\"y\\"]"}], "n": 1, "e": " "}')) == ["x", "y"] and R.passages_of("[not json]") == ["[not json]"] and R.passages_of(" ") == [] and R.passages_of("[]") == []
