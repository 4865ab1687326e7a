"""Recall and precision on texts that are no exemplars.

TUNED was looked at while the exemplars were extended; FRESH was written afterwards and changed nothing. Word weights are
those of ordinary content.
"""

import numpy as np

from loomtrace.llm import exemplars as E
from loomtrace.llm import residue as R

ORDINARY = [
    "Open the start page", "Sign in as kiosk visitor and open the journal view", "Set 12 pages for the weekly invoice and confirm", "The total matches the ledger and the invoice keeps its date", "Press the save button", "Repeat the action in the dark theme",
    "Rename the partial packing list in the health editor", "The request is refused with a clear reason and the list stays readable", "A warning with the field name is displayed", "The user receives one message", "Return to the first tab", "Reload the list",
]
TUNED = [
    "Request failed with status code 500", "Loading, please wait", "Content coming soon", "Diese Seite benötigt JavaScript", "We are experiencing technical difficulties", "This step is intentionally left blank",
    "Oh no! An error has occurred while loading this test.", "Error 504: gateway timeout", "The model is overloaded, please try again later", "HTTP 429 Too Many Requests", "Unable to load the requested content.",
    "Service temporarily unavailable, please retry", "JavaScript must be turned on to use this site", "You need to activate JavaScript in your browser", "Please allow scripts and reload the page", "Une erreur est survenue, veuillez réessayer plus tard",
    "Se ha producido un error inesperado", "Esta página requiere JavaScript", "页面不存在", "请启用JavaScript以继续", "Expected result goes here", "Your test data here", "Step to be determined", "Details to be provided later", "Insert the expected result here",
    "<your name here>", "{{ customer.name }} logs in", "Open [PAGE_NAME] and log in as ${role}", "Click to add text", "No description available", "Description to follow", "Page under construction", "Fatal error: connection refused",
    "Open the list of trucks\nTODO write this step\nClose it", "选择列表。请稍后再试。关闭页面。", "Open the invoice list and select the first row something went wrong please try again later and go on with the next row",
]
FRESH = [
    "500 - Internal server error", "The page you requested could not be found.", "Your request could not be completed. Please try again.", "Could not connect to the server", "An unexpected error occurred", "Request timed out", "You do not have permission to access this page",
    "This site is down for maintenance", "Ein Fehler ist aufgetreten, bitte versuchen Sie es später erneut", "Erreur 404 : page introuvable", "服务器内部错误，请稍后再试", "JavaScript is disabled in your browser", "Enable JavaScript to continue", "This website requires JavaScript",
    "Activez JavaScript pour continuer", "Please enable cookies and JavaScript", "TBD", "to be confirmed", "FIXME: complete test data", "Lorem ipsum", "lorem ipsum dolor sit amet consectetur", "Placeholder text", "Enter the expected result here",
    "Under construction - check back later", "Log in as {{user}} with %password%", "The total of <<AMOUNT>> is shown", "Open __URL__", "[insert step]", "sample text", "not yet defined", "Result to be added by the author", "Texte à venir", "xxx xxx",
]
CONTENT = [
    "Enter a wrong password and check that the message 'Please try again later' appears", "Disable JavaScript and open the order form", "The system shows an error page when the service is unavailable", "Verify that the placeholder of the search box is grey",
    "The template list shows three templates", "Create a template named Invoice and save it", "Request a missing page and expect status 404", "The server answers with 403 Forbidden for guests", "The user sees the message that the session has expired",
    "Check that the text 'Lorem ipsum' is shown in the preview", "Enter TODO as the name of the list and save", "The loading indicator disappears after two seconds", "Wait until the page has loaded", "Log in as administrator", "Open the error log and filter by severity",
    "The request is retried three times before it fails", "The description is shown below the title", "Upload a file that is too large and read the warning", "Fill in the form and submit it", "The page is not found in the search results after deletion",
    "The access of the guest is denied", "The script of the import runs at midnight", "Insert a row above the header", "Type the name of the customer into the field", "The value of the field is kept after reload", "The administrator is contacted by mail when the job fails",
    "Set the timeout to 30 seconds", "The connection is closed after the timeout", "Open the page with scripts blocked and check that the menu works", "The order is marked as pending", "Leave the description blank and save", "The list is empty",
]


def index(exemplars=E.LABELLED):
    counts, total = np.zeros(R.BUCKETS, dtype=np.int64), 0
    for text in ORDINARY:
        for p in R.windows_of(text):
            total += 100
            for w in set(p):
                counts[R.bucket(w)] += 100
    return R.Index(counts, total, exemplars)


def test_texts_that_are_no_exemplars():
    known = {tuple(R.words_of(t.replace("_", " "))) for t, _ in E.LABELLED}
    ix = index()
    found = {t: ix.case(R.windows_of(t)) for t in [*TUNED, *FRESH, *CONTENT, *ORDINARY]}
    wrong = [t for t in [*CONTENT, *ORDINARY] if found[t]]
    for name, texts in (("tuned", TUNED), ("fresh", FRESH)):
        new = [t for t in texts if tuple(R.words_of(t)) not in known]
        hits = sum(found[t] for t in new)
        print(name, len(new), hits, [t for t in new if not found[t]], wrong)
        assert len(new) > 20 and hits / len(new) >= 0.9
        assert hits / (hits + len(wrong)) >= 0.9


def test_half_of_the_labels():
    """Each half of the exemplars finds those of the other that say the same in other words."""
    phrases = [t for t, label in E.LABELLED if label == "phrase"]
    rest = [(t, label) for t, label in E.LABELLED if label != "phrase"]
    hits = n = 0
    for part in (0, 1):
        ix = index([*((t, "phrase") for t in phrases[part::2]), *rest])
        for t in phrases[1 - part :: 2]:
            hits += ix.case(R.windows_of(t.replace("_", "")))
            n += 1
    print("other half", hits, n)
    assert hits / n >= 0.75


def test_other_exemplars(spark):
    """A table of labelled texts takes the place of the default one; without residue exemplars nothing is residue."""
    tests = spark.createDataFrame([("a", ["zork mip fnord"], None, None), ("b", ["TODO"], None, None)], "test_id string, test_steps array<string>, expected_result string, test_data string")
    own = spark.createDataFrame([("zork mip fnord", "phrase"), (None, "phrase"), ("TODO", "content")], "text string, label string")
    assert [tuple(r) for r in R.residue_fields(tests, exemplars=own).collect()] == [("a", "test_steps")]
    assert R.residue_fields(tests, exemplars=own.where("label = 'content'")).count() == 0
