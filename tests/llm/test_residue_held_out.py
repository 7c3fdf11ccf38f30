"""Residue in words that no exemplar has, and text that only speaks of such things; the figures stand in the README."""

from folioscope.llm import residue

RESIDUE = [
    "Please enable JavaScript to continue using this application.",
    "You must enable JavaScript in order to use this site",
    "This application requires JavaScript to run.",
    "Enable JavaScript and cookies to continue",
    "JavaScript is turned off in your browser. Please turn JavaScript on.",
    "Sorry, the page you are looking for could not be found.",
    "The requested page was not found",
    "Oops! That page can't be found.",
    "500 Internal Server Error. Please try again later.",
    "The server encountered an error and could not complete your request.",
    "502 Bad Gateway nginx",
    "Service Unavailable. The server is temporarily unable to service your request.",
    "Gateway Timeout. The upstream server did not respond in time.",
    "Error: database connection failed",
    "The site is down for scheduled maintenance. Please try again later.",
    "Fatal error: Uncaught Error: Call to undefined method",
    "Traceback (most recent call last): File",
    "You don't have permission to access this page.",
    "Access to this page has been denied.",
    "403 Forbidden. You do not have permission to access this server.",
    "Your session has timed out. Please sign in again to continue.",
    "You must sign in to view this page",
    "Please verify that you are not a robot",
    "Checking your browser before you access the site.",
    "You have been blocked from viewing this site",
    "Please wait while the page is loading",
    "You are being redirected. Please wait.",
    "This page is under construction. Coming soon!",
    "TODO: write this section",
    "Content coming soon.",
    "Your content goes here",
    "Add your text here.",
    "This is a sample page. Edit it or delete it.",
    "This article is a stub and needs content.",
    "Lorem ipsum dolor sit amet, sed do eiusmod tempor",
    "Duis aute irure dolor in reprehenderit in voluptate",
    "Dear {{customer.name}}, thanks",
    "Welcome to %SITE_NAME%",
    "Total: [object Object]",
]
TEXT = [
    "If JavaScript is turned off, the menu falls back to plain links.",
    "The client retries a request when the gateway answers with 502.",
    "A 403 response means that the token lacks the scope of the call.",
    "Sessions expire after thirty minutes without a request.",
    "The maintenance window is announced two days before it begins.",
    "Use the loading state to show that rows are being fetched.",
    "Permission to read a page follows from the roles of its space.",
    "The redirect keeps the query string of the page it comes from.",
    "Construction of the index takes a few minutes for a large site.",
    "The robot account signs in with a key of its own.",
    "Add a paragraph of text below the heading, then save the page.",
    "A stub answers in place of the real service during the tests.",
    "Errors of the database are written to the log with their code.",
    "The sample page in the tutorial has three sections.",
    "When the connection fails, the worker waits and then tries again.",
    "The browser caches the script for one day.",
    "Replace YOUR_TOKEN with the token of your workspace.",
    "Write the heading in sentence case and the text in short lines.",
    "Cookies hold the language that the reader chose.",
    "A page that was moved keeps its old address as an alias.",
    "Set the timeout to 30 seconds if the upstream is slow.",
    "To delete a page, open its menu and choose the last entry.",
    "The template fills the name of the product when the page is built.",
    "Undefined keys are left out of the response.",
    "The traceback shows in which step the task failed.",
    "Ask an owner of the space if you cannot access its pages.",
    "The server sends the body in pieces of one megabyte.",
    "Blocked addresses are listed on the security page.",
    "Coming releases are described in the roadmap.",
    "Wait until the status is ready before you start the next step.",
]


def found(lines):
    known = residue.Exemplars({"0": 900, "the": 950, "to": 900, "is": 800, "of": 900, "page": 500, "this": 500, "you": 300, "not": 400, "be": 500, "a": 950, "and": 950, "in": 900, "your": 300}, 1000)
    return [x for x in lines if known.page(x)]


def test_held_out_wording():
    exemplars = {" ".join(residue.terms(t)) for _, t in residue.RESIDUE}
    assert not exemplars & {" ".join(residue.terms(x)) for x in RESIDUE}
    hits, wrong = found(RESIDUE), found(TEXT)
    assert len(hits) / len(RESIDUE) >= 0.9
    assert len(hits) / (len(hits) + len(wrong)) >= 0.95
