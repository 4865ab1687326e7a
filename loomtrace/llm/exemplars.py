"""Labelled exemplars of residue and of content that only talks about such things: the default exemplar table.

A row is a text and its label:

* ``phrase``: residue; an underscore is an open place of a few words
* ``bag``: residue in any order and number of its words
* ``part``: residue wherever it stands
* ``content``: content about templates, placeholders, error pages and scripts
* ``frame``: words around a quoted message that make it the behaviour under test

Any table of (text, label) can take the place of this one. Texts are normalised as passages are, so ``0`` stands for
every number, ``js`` for every name of scripts, ``enable`` for every way to say it and ⌂ for every unfilled part.
"""

from __future__ import annotations

from http import HTTPStatus

PART = "⌂"  # an unfilled template part
BRACKET = "⊏"  # a lower-case phrase in square brackets
DOTS = "…"

#: Messages of services that failed.
ERRORS = [
    *(f"_ {p}" for p in (
        "could not process your request", "is currently overloaded", "is temporarily unavailable", "did not answer in time", "refused the connection",
        "returned an invalid response", "encountered an internal problem", "is down for maintenance",
    )),
    "sorry", "oops", "we're sorry something went wrong", "something went wrong", "an unexpected error occurred while processing your request",
    "please try again later", "try again in 0 minutes", "retry in 0 seconds", "error code 0", "go back to the home page",
    "if the problem persists contact the administrator", "trace id 0", "incident 0 has been logged", "reference 0",
    "error generation request timed out after 0 s", "i'm sorry but the model is currently overloaded with other requests",
    "too many requests from your network slow down", "access denied", "you do not have permission to view this resource",
    "your session has expired", "please sign in again to continue", "http status 0 _", "the server refused to fulfil the request",
    "internal server error", "too many requests", "bad gateway", "not found", "forbidden", "unauthorized", "service unavailable", "gateway time out", "bad request",
    "error", "seite nicht gefunden fehler 0", "upstream connect error or disconnect before headers reset reason 0",
    "oops request 0 could not be completed", "traceback most recent call last file gen line 0 in run keyerror _",
    "the page you are looking for may have been moved or deleted", "page introuvable erreur 0", "pagina no encontrada error 0",
    *(p for s in HTTPStatus if s >= 400 for p in (s.phrase, f"error 0 {s.phrase}", f"http error 0 {s.phrase}")),
    "temporarily unavailable", "_ is temporarily unavailable please retry", "please retry", "retry later", "something went wrong on our side", "it's not you it's us", "we are working on it", "dieser dienst ist zurzeit nicht erreichbar",
    "request failed", "_ failed with status code 0", "_ failed with error 0", "failed to load _", "failed to fetch", "could not load _", "unable to load _", "unable to connect to the server",
    "an error has occurred", "an error occurred while loading _", "an unexpected error occurred", "unexpected error", "we encountered an error", "this page could not be found", "this page isn't working",
    "we are having technical problems", "experiencing technical difficulties", "due to technical difficulties _", "the site is temporarily down for maintenance", "this site can't be reached",
    "we could not find the page you requested", "the requested url was not found on this server", "the requested resource is not available", "please contact support if the problem persists",
    "please try again", "please try again in a few minutes", "please refresh the page", "please check your connection", "check your internet connection and try again", "connection timed out", "connection refused",
    "connection reset by peer", "the operation timed out", "the server took too long to respond", "no response from server", "rate limit exceeded", "quota exceeded", "invalid api key", "login required",
    "you must be logged in to view this page", "your request could not be processed", "unhandled exception", "null pointer exception", "stack trace", "segmentation fault", "fatal error", "no data received",
    "seite konnte nicht geladen werden", "ein fehler ist aufgetreten", "interner serverfehler", "zugriff verweigert", "dienst nicht verfügbar", "bitte versuchen sie es später erneut",
    "une erreur est survenue", "une erreur s'est produite", "erreur interne du serveur", "accès refusé", "service indisponible", "veuillez réessayer plus tard",
    "se ha producido un error", "error interno del servidor", "acceso denegado", "servicio no disponible", "inténtelo de nuevo más tarde", "发生错误", "页面不存在", "服务器内部错误", "请稍后再试", "无法访问此页面",
]
#: Notices that scripts are needed.
SCRIPTS = [
    *(f"{p} {q}" for p in ("please enable js", "you must enable js in your browser", "enable js", "js seems to be off enable it", "_ does not work without js enable it")
      for q in ("to continue", "to view this page", "to see the _", "to use this application", "before you proceed", "and reload", "for this content to load", "in order to display the _")),
    "you must enable js in your browser", "you need to enable js to run this app", "js is disabled", "enable it and reload the page", "js seems to be off", "js seems to be off enable it",
    "enable it to view this page", "enable it to continue", "enable it before you proceed", "enable it in order to display the _", "enable it to see the _", "enable it for this content to load", "enable it and reload",
    "your browser does not run js or they are blocked the content cannot be shown", "sorry your browser does not support js or it has been disabled",
    "this site requires js to be enable in your browser", "for full functionality of this site it is necessary to enable js", "js must be enable for this content",
    "bitte aktivieren sie js um diese seite anzuzeigen", "habilite los js del navegador para ver el contenido", "veuillez activer js pour continuer",
    "checking your browser before access", "js and cookies required", "ray 0", "just a moment", "js support is needed",
    "this page requires js", "this application requires js", "js is required", "js is required to use this application", "js must be enable", "js is turned off", "js is not enable in your browser", "your browser has js disabled",
    "we've detected that js is disabled in this browser", "please enable js and cookies", "enable js and cookies to continue", "please turn js on", "this feature needs js", "you need js to view this content",
    "verifying that you are human", "please complete the security check to access this site", "please enable cookies",
    "diese seite benötigt js", "für diese seite wird js benötigt", "js ist deaktiviert", "bitte js aktivieren", "diese anwendung erfordert js", "cette page nécessite js", "js est désactivé", "js doit être activé pour _",
    "esta página requiere js", "js está desactivado", "active js para continuar", "请启用 js", "请启用 js 以继续", "此页面需要 js",
]
_NOUNS = ["step", "input", "value", "result", "data", "text", "precondition", "expected outcome", "expected result", "test data", "description"]
_MARKS = ["todo", "fixme", "xxx", "tbd", "tbc", "to do"]
#: Text that keeps a place.
FILLER = [
    *_MARKS, "placeholder", DOTS, BRACKET, "to be defined", "to be defined in release 0", "tbc by author", "notavailable fill in later", "fill in later",
    "dummy entry replace before review", "same as above but different", "execute test action", "input test data then verify result",
    "sample text sample text sample text", "blindtext folgt", "a completer", "describe the expected outcome of this step", "todo write this step", "replace me",
    "lorem ipsum dolor sit amet consectetur adipiscing elit", "lorem ipsum", "foo bar", "asdf qwer", "xxx xxx xxx", "test test test",
    *(f"{m} {v} {n}" for m in _MARKS for v in ("describe", "define", "complete", "clarify", "ask about", "write") for n in _NOUNS),
    *(f"{v} {a} {n} {w}" for v in ("enter", "write", "insert", "put", "add", "type") for a in ("your", "actual", "proper", "the") for n in _NOUNS for w in ("here", "later", "in this box", "before review")),
    *(f"{a} {n} {w}" for a in ("dummy", "default", "generic", "sample", "example", "your") for n in _NOUNS for w in ("here", "goes here", "text", "content", "replace me")),
    *(f"{n} {w}" for n in _NOUNS for w in ("goes here", "description goes here", "to follow", "pending from author", "not yet written", "still missing", "will be added")),
    *(f"example {n} 0 example {n} 0" for n in _NOUNS),
    "loading", "loading please wait", "please wait", "please wait while the page loads", "coming soon", "_ coming soon", "this page is under construction", "under construction", "work in progress", "check back later",
    "intentionally left blank", "this page is intentionally left blank", "this section was intentionally left blank", "no content available", "content not available", "content goes here", "not applicable at this time",
    "no description provided", "no description", "description missing", "missing description", "untitled", "new document", "click to add text", "click here to enter text", "type here", "start typing", "edit me", "change me",
    "placeholder for _", "todo add _", "todo fill in _", "todo complete", "tbd waiting for input", "tbd by author", "text will follow", "_ to be supplied", "_ to be specified", "_ goes here", "_ not available yet",
    "this is a placeholder", "placeholder text", "dummy text", "sample content", "example text", "test data here", "your name here", "company name here", "insert image here", "details to follow", "more details to come",
    "more information coming soon", "awaiting input", "waiting for input from author", "to be completed", "to be completed by the author", "to be confirmed", "to be determined", "to be announced", "to be provided", "to be written", "not yet defined", "not yet available",
    "see above", "as above", "same as above", "platzhalter", "noch zu definieren", "wird noch ergänzt", "hier text einfügen", "inhalt folgt", "à définir", "à compléter", "texte à venir", "contenu à venir", "por definir", "por completar", "texto de relleno", "próximamente", "待定", "待补充", "此处填写", "敬请期待", "占位符",
]
#: Words without meaning.
NONSENSE = "lorem ipsum dolor foo bar baz qux xxx asdf qwer qwerty dummy test abc blah"
#: Content about templates, errors and scripts.
CONTENT = [
    "enable js off in the browser and reload the start page", "turn off js in the browser and reload the start page", "a notice asks the user to enable js and the static menu still works",
    "the error page shows reference number and no stack trace for the _", "status 0 is returned and the _ stays unchanged",
    "the reply has status 0 and the branded not found screen offers a link to the _", "the user is told that the session has expired and the _ is kept as draft",
    "wait until the session of the _ has expired then click save", "stop the upstream host so that the _ screen answers with status 0", "request a page that does not exist for the _",
    "set the label of the _ to todo and open the task board", "the _ displays to be defined for the _ without owner until one is set",
    "fill the description with a lorem ipsum paragraph of 0 characters to reach the size limit", "todo list", f"{PART} of {PART}",
    "leave the optional remark of the _ blank", "the preview of the mail template lists its fields name and date for editing",
    "press the save button", "add entry", "one entry is added", "return to the first tab", "send the request again", "reload the page", "reload the list", "open the start page",
]
#: How a message is reported rather than given.
FRAMES = [
    "the message _ is displayed", "displays the message", "shows the message", "the page shows the message", "the text _ is shown", "a notice says", "a banner reads", "a warning says", "the user is told", "the user sees",
    "the dialog says", "verify that", "check that", "confirm that", "make sure that", "assert that", "expect the error", "the response is", "responds with", "answers with", "the error is logged", "the error is returned",
    "is returned", "is displayed", "is shown", "appears", "asks the user", "prompts the user", "the label reads", "instead of",
]

LABELLED: list[tuple[str, str]] = [
    *((t, "phrase") for t in [*ERRORS, *SCRIPTS, *FILLER]), (NONSENSE, "bag"), (PART, "part"), *((t, "content") for t in CONTENT), *((t, "frame") for t in FRAMES),
]
