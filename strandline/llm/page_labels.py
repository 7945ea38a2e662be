"""Labelled pages for the page-body model: annotated wordings that decide a page's lines.

The tables hold no labels, so the training pages are labelled here: a page counts as labelled line by line with these
annotations of page furniture (reduced to lower-case words), and furniture lists take the lines below their title.
Lines that no annotation names are article. The model generalises from the words, shapes and places of such lines, and
from their neighbours in the page's tree; it never sees the annotations.
"""

from __future__ import annotations

import re

# The annotated wordings.
MENU = "search|contents|community|downloads|assessments|certifications|support|sign in|products|pricing|documentation|training|free account|code samples|release notes|skip to main content|suche|dokumentation|anmelden|preise|zum hauptinhalt wechseln|hilfe|beispiele|konto|schulungen|produkte|rechercher|tarifs|aide|produits|compte|se connecter|passer au contenu principal|exemples|formation|formations|communauté|contenu"
TITLES = "in this article|on this page|table of contents|page contents|in this section|contents|auf dieser seite|in diesem artikel|dans cet article|sur cette page|related articles|recommended for you|readers also opened|popular topics|trending this week|mehr von \\w+|more from \\w+|plus de \\w+|articles liés|articles connexes|verwandte artikel|beliebte themen"
WORDINGS = (
    "was this page helpful( yes no)?", "war diese seite hilfreich( ja nein)?", "cette page vous a t elle été utile( oui non)?",
    "submit and view feedback for this \\w+ page", "feedback", "feedback an \\w+ senden", "contact \\w+ support or ask the community",
    "machine translated text on \\w+ pages is offered for convenience only", "maschinell übersetzte texte von \\w+ dienen nur zur orientierung",
    "\\w+ names and marks belong to \\w+ works other names belong to their owners", "information on \\w+ pages may change without notice and creates no warranty of any kind",
    "preview features of \\w+ are provided as they are and are excluded from service agreements", "angaben auf seiten von \\w+ können sich ohne ankündigung ändern",
    "\\w+ works all rights reserved in every region", "\\w+ werke alle rechte in jeder region vorbehalten", "copyright \\w+ imprint and data protection",
    "theme", "english united states( theme light dark high contrast)?", "previous versions contribute accessibility sitemap", "privacy terms of use trademarks \\w+ blog",
    "impressum datenschutz nutzungsbedingungen", "confidentialité conditions marques", "accessibilité", "barrierefreiheit",
    "shared times by readers of \\w+", "share this page by mail chat or feed", "diese seite per mail oder chat teilen", "partager cette page par courriel ou messagerie",
    "copy link print share to a channel", "save this article to a \\w+ reading list", "follow \\w+ for more articles like this one",
    "\\w+ and its partners would like to remember your visit", "your privacy matters to \\w+ choose which storage we may use", "by continuing to browse \\w+ you accept our use of cookies",
    "this site stores small files on your device \\w+ needs some of them", "we use cookies and similar storage on \\w+ pages", "\\w+ verwendet cookies um diese website zu betreiben und zu messen",
    "mit der nutzung von \\w+ stimmen sie der speicherung zu", "nur notwendige zulassen", "accept decline cookie settings", "accept all reject manage choices", "allow all", "manage preferences",
    "\\w+ uses cookies to keep this site working and to measure traffic", "\\w+ utilise des cookies pour faire fonctionner ce site", "en poursuivant vous acceptez les traceurs de \\w+", "continuer sans accepter",
    "envoyer vos commentaires à \\w+", "les informations des pages \\w+ peuvent changer sans préavis", "les textes traduits par \\w+ sont fournis à titre indicatif", "\\w+ tous droits réservés dans toutes les régions",
    "mal von lesern bei \\w+ geteilt", "partagé fois par les lecteurs de \\w+", "article de l équipe [\\w ]+ minutes de lecture",
    "got it thanks", "alle akzeptieren ablehnen einstellungen", "advertisement", "anzeige", "try \\w+ free for days", "subscribe", "join the \\w+ letter this month .*", "register now for the \\w+ summit .*",
    "comments", "\\w+ replied hours ago", "log in to comment", "tags .*", "next .*", "previous .*", "home .*",
    "article by the [\\w ]+ documentation team minute read", "artikel vom team [\\w ]+ minuten lesezeit", "contributors from the [\\w ]+ group at \\w+",
    "maintained by [\\w ]+ reading time min applies to all tiers", "zuletzt geprüft am \\w+ durch [\\w ]+", "dernière révision le \\w+ par [\\w ]+", "last reviewed on \\w+ by the [\\w ]+ desk",
)

_MENU = re.compile(f"(?:(?:{MENU})(?: |$))+")
_TITLE = re.compile(TITLES)
_WORDING = re.compile("|".join(WORDINGS))
_LINK = re.compile(r"\]\([^)]*\)")
_WORDS = re.compile(r"\d*[^\W\d_][^\W_]*")


def reduced(line: str) -> str:
    """Lower-case words of a line, without link targets, numbers and signs."""
    return " ".join(_WORDS.findall(_LINK.sub(" ", line).lower()))


def label_lines(lines: list[str]) -> list[bool | None]:
    """For each line of a page: True for furniture, False for article, None for a blank line."""
    out: list[bool | None] = []
    fenced = listing = False
    for line in lines:
        if not line.strip():
            listing = False
            out.append(None)
            continue
        if line.lstrip().startswith("```"):
            fenced, listing = not fenced, False
            out.append(False)
            continue
        words = reduced(line)
        plain = not fenced and not line.lstrip().startswith(("# ", "> "))
        if fenced:
            furniture = False
        elif _TITLE.fullmatch(words) and not re.match(r"\s*[-*1]\.? ", line):
            furniture = listing = True
        elif _WORDING.fullmatch(words) and not (words.startswith(("next ", "previous ", "tags ", "home ")) and "versions" not in words and not re.match(r"[\W_]*(?:next:|previous:|tags:|home[\W_])", line.lower())):
            furniture, listing = True, False
        elif _MENU.fullmatch(words) and plain and not re.match(r"\s*#", line):
            furniture = True
        else:
            listing = listing and not re.match(r"\s*(#|>|\||```)", line)
            furniture = listing
        out.append(furniture)
    return out
