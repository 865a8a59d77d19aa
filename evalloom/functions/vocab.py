"""Word lists, bins, signals and phrases that results depend on."""

from __future__ import annotations

# Fixed values of the profile format.
STOPWORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its of on or she that the their they this to was were with you"
).split()
SPAM_KEYWORDS = "free win winner won urgent click prize offer congratulations claim limited exclusive guaranteed cash money reward bonus deal discount".split()
FIRST_PERSON = "i me my mine we us our ours i'm i've i'll i'd im we're we've we'll".split()
SECOND_PERSON = "you your yours u ur you're you've you'll you'd".split()
SLANG = "u ur r 2day 2moro 2nite gr8 thx plz pls wat wanna gonna luv lol tho cuz msg txt b4 l8r w8 omg btw idk".split()
#: (least, most); the last bin has no end.
WORD_BINS = ((1, 5), (6, 10), (11, 15), (16, 20), (21, 30), (31, 50), (51, None))
CHAR_BINS = ((1, 25), (26, 50), (51, 100), (101, 200), (201, 400), (401, None))
QUANTILES = (10, 25, 50, 75, 90)
SIGNALS = ("phishing_link", "money_promise", "excessive_caps", "urgency", "spam_keywords")
SIGNAL_RATES = {"phishing_link": "url_rate", "money_promise": "currency_rate", "excessive_caps": "caps_rate", "urgency": "exclaim_rate", "spam_keywords": "keyword_rate"}
STYLES = ("question_rate", "exclaim_rate", "first_person_rate", "second_person_rate", "contraction_rate", "digit_rate", "uppercase_word_rate", "texting_slang_rate")
STYLE_PHRASES = {
    "question_rate": "phrase it as a question",
    "exclaim_rate": "include an exclamation mark",
    "first_person_rate": "write in the first person",
    "second_person_rate": "address the reader directly",
    "contraction_rate": "use contractions",
    "digit_rate": "include a number",
    "uppercase_word_rate": "include an ALL-CAPS word",
    "texting_slang_rate": "use texting slang",
}
EDIT_OPERATIONS = {"M": "omit a required", "U": "add an unnecessary", "R": "use a wrong"}
EDIT_CATEGORIES = {
    "DET": "article/determiner",
    "PREP": "preposition",
    "VERB:TENSE": "verb tense",
    "VERB:FORM": "verb form",
    "VERB:SVA": "subject-verb agreement",
    "NOUN:NUM": "noun number",
    "PRON": "pronoun",
    "SPELL": "spelling",
    "WO": "word order",
    "PUNCT": "punctuation",
    "ADJ": "adjective form",
    "MORPH": "word form",
    "ORTH": "capitalization or spacing",
}
EDIT_TYPES = "M:DET U:DET R:DET M:PREP U:PREP R:PREP R:VERB:TENSE R:VERB:FORM R:VERB:SVA R:NOUN:NUM R:PRON R:SPELL R:WO M:PUNCT U:PUNCT R:PUNCT R:ADJ R:MORPH R:ORTH".split()
HEADLINE = {"spam": "f1", "gec": "errant.f0.5", "sentiment": "macro_f1"}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def bin_label(least: int, most: int | None) -> str:
    return f"{least}+" if most is None else f"{least}-{most}"


def edit_phrases() -> dict[str, str]:
    """What each supported type of edit asks for, in words."""
    return {t: f"{EDIT_OPERATIONS[t.split(':', 1)[0]]} {EDIT_CATEGORIES[t.split(':', 1)[1]]}" for t in EDIT_TYPES}
