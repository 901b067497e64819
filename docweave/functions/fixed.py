"""Word lists, patterns and limits whose content defines the results."""

# Spelled-out numbers accepted in labels.
SPELLED = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20,
}
SPELLED_ALT = "|".join(w.title() for w in SPELLED)
SPELLED_12_ALT = "|".join([w.title() for w in SPELLED][:12])

# Characters treated as a space, and characters that vanish.
SPACE_CHARS = "\u00a0\u2009\u2002\u2003\u200a\u202f\u205f\u3000"
ZERO_WIDTH = "\u200b\u200c\u200d"

# Document types labelled "Section"; every other type is "Chapter".
SECTION_TYPES = ("section", "policy")

# Citation and label patterns.
CITATION_LABELLED = r"(?:Section|Chapter)\s+[\dIVXLCDM]+(?:\.[A-Za-z\d]+)+"
CITATION_BARE = r"[\dIVXLCDM]+(?:\.[A-Za-z\d]+){2,}"
CITATION = CITATION_LABELLED + r"|(?<![\p{L}\p{N}_])" + CITATION_BARE + r"(?![\p{L}\p{N}_])"
DEGREES = (
    r"D\.?V\.?M", r"D\.?N\.?P", r"D\.?M\.?D", r"Ed\.?D", r"Ph\.?D", r"M\.?S\.?N",
    r"M\.?P\.?H", r"M\.?B\.?A", r"M\.?Ed", r"M\.?S", r"M\.?A", r"B\.?S", r"B\.?A",
    r"B\.?S\.?N", r"LL\.?M", r"J\.?D", r"O\.?D", r"D\.?D\.?S", r"Psy\.?D",
)
DEGREE = r"^(?:" + "|".join(DEGREES) + r")\.?$"
LETTERS_DOTTED = r"^[A-Za-z]{1,4}(?:\.[A-Za-z]{1,4}){1,4}\.?$"
LABEL_WORD = r"^(?:Chapter|Section)\s+"
CITED_LABEL = r"^(?:Chapter|Section)\s+[\dIVXLCDM]+"
HEADING_NUMBER = (
    r"^(?:Chapter|Section)\s+((?:" + SPELLED_ALT + r"|[\dIVXLCDM]+)(?:\.[A-Za-z\d]+)*)"
    r"|^([\dIVXLCDM]+(?:\.[A-Za-z\d]+)+)"
)
_TOKEN = r"(?:\d+|[IVXLCDM]{1,6}|[A-Z]{1,3}|[a-z]{1,3})"
HEADING_PREFIX = (
    r"^\s*(?:"
    r"(?i:(?:Chapter|Section))\s+(?:[IVXLCDM\d]+|(?:" + SPELLED_ALT + r"))(?:\.[A-Z\d]+)*(?:\s*[:.–—\-])?\s+|"
    + _TOKEN + r"(?:[.\s]+" + _TOKEN + r"){1,5}\.?\s+(?:[:.–—\-]\s*)?|"
    r"(?i:[IVXLCDM]+)\.(?:[A-Z]{1,3}|[a-z]{1,3})(?:\.\d+){0,3}\.?\s+(?:[:.–—\-]\s*)?|"
    r"(?i:[IVXLCDM]+)(?:\.\d+){0,3}\.?\s+(?:[:.–—\-]\s*)?|"
    r"(?:[A-Z]{1,3}|[a-z]{1,3})\.\s+(?:[:.–—\-]\s*)?|"
    r"\d+(?:\.\d+){0,3}(?:[.)])?\s+(?:[:.–—\-]\s*)?"
    r")"
)
_INFER_TOKEN = r"(?:\d+|[IVXLCDMivxlcdm]{1,6}|[A-Z]{1,3}|[a-z]{1,3})"
HEADING_INFER = (
    r"^\s*(?:(?i:Chapter|Section)\s+)?(" + _INFER_TOKEN + r"(?:\.\s*" + _INFER_TOKEN + r"){1,5})\b"
)
LABEL_BODY = r"^[\dIVXLCDM]+(?:\.[A-Za-z\d]+)*\s*(?:[-:.–—]\s*)?"
SLUG_LABEL = r"^(?:Chapter|Section)\s+[\dIVXLCDM]+(?:\.[A-Za-z\d]+)*\s*(?:--|[-:.])\s*"
SLUG_DOTTED = r"^(?:[A-Z0-9]+(?:\.[A-Z0-9]+)+|[A-Z0-9]+\.)\s+"
FULL_HEADING = r"^(Chapter|Section)\s+([\d\p{L}\p{N}_.]+)\s*[-:–—.]\s*(.+)"
PARTIAL_HEADING = r"^((?:[0-9]+|[IVXLCDM]{1,10}|[A-Z])(?:\.[A-Z0-9]+)*\.?)[\s\t]+(.+)"
SUB_NUMBER = r"^([A-Z\d]+)[\.\s]+(.+)"
NOT_A_NUMBER = ("IN", "TO", "OR", "AS", "AT", "BY", "OF", "ON", "THE", "FOR", "AND")
ALREADY_NUMBERED = r"^(?:Chapter|Section)\s+[\d.]+"
ALREADY_DECIMAL = r"^\d+(?:\.\d+)*\s+"
CITATION_WORDS = ("RCW", "WAC", "BPPM")
NUMBER_PREFIX = (
    r"^(?:Chapter|Section)\s+[\p{L}\p{N}_\dIVXLCDM]+",
    r"^(?:[IVXLCDM]+|[A-Z]|\d+)(?:\.[A-Z\d]+)*[.)]\s+",
    r"^(?:[IVXLCDM]+|[A-Z]|\d+)(?:\.[A-Za-z\d]+){1,5}\S",
)
LOOKS_NUMBERED = (
    (r"^(?:Chapter|Section)\s+[\p{L}\p{N}_\dIVXLCDM]+", True),
    (r"^\d+(?:\.\d+)+\s+", False),
    (r"^[IVXLCDM]+\.[A-Z0-9]+", True),
    (r"^[A-Z]\.\s+", False),
)
_AFTER_NUMBER = r"(?:(?:\s*[:\-–—]\s*)|\s+|\.\s+)[\p{L}\p{N}_]"
GUESS_LEVEL = (
    (r"^Section\s+[IVXLCDM]+" + _AFTER_NUMBER, 1),
    (r"^Section\s+\d+" + _AFTER_NUMBER, 1),
    (r"^Chapter\s+(?:" + SPELLED_12_ALT + r"|\d+|[IVXLCDM]+)" + _AFTER_NUMBER, 1),
    (r"^[IVXLCDM]+\.[A-Z]\.\s+[\p{L}\p{N}_]", 2),
    (r"^[IVXLCDM]+\.[A-Z]\.\d+(?:\.\d+){0,2}\s+[\p{L}\p{N}_]", 3),
    (r"^\d+\.\d+\.\d+(?:\.\d+)*\s+[\p{L}\p{N}_]", 3),
    (r"^\d+\.\d+\s+[\p{L}\p{N}_]", 2),
    (r"^[A-Z]\.\s+[\p{L}\p{N}_]", 3),
)
LIST_ROMAN = (
    r"^\s*((?i:i|ii|iii|iv|v|vi|vii|viii|ix|x|xi|xii|xiii|xiv|xv|xvi|xvii|xviii|xix|xx))[.)]\s+"
)
LIST_ALPHA = r"^\s*([a-zA-Z])[.)]\s+"
LIST_DECIMAL = r"^\s*(\d+)[.)]\s+"
TOC_TITLE = r"Table of Contents"
TOC_YEAR = r"^\d{4}(?:-\d{4})?$"
TOC_COVER = r"^(?:Policies and Procedures|Faculty)\s+Manual$"
TOC_CHAPTER = (
    r"^Chapter\s+(?:" + SPELLED_12_ALT + r"|\d+|[IVXLCDM]+)\s+[-–—]\s+[\p{L}\p{N}_]",
    r"^Section\s+[IVXLCDM]+\s+[-–—]\s+[\p{L}\p{N}_]",
    r"^Section\s+\d+\s+[-–—]\s+[\p{L}\p{N}_]",
)
BARE_HOST = (
    r"^(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?::\d{1,5})?(?:[/?#]\S*)?$"
)
TEXT_URL = r"https?://[^\s\)\]\}>\"']+"

# Markup that may appear in published documents.
ALLOWED_TAGS = tuple(
    "a abbr article aside b blockquote br caption cite code col colgroup dd div dl dt em figcaption "
    "figure footer h1 h2 h3 h4 h5 h6 header hr i img li main nav ol p pre section small span strong "
    "button input sub summary sup table tbody td tfoot th thead tr u ul".split()
)
ALLOWED_ATTRS = {
    "*": "class id style role aria-label aria-labelledby aria-describedby aria-live tabindex colspan "
         "rowspan scope headers lang title",
    "a": "href name target rel class id title",
    "img": "src alt width height loading class decoding title",
    "th": "abbr scope colspan rowspan headers class id",
    "td": "colspan rowspan headers class id",
    "div": "class id style role aria-label aria-labelledby data-toc-depth data-manual-type "
           "data-numbering-mode data-heading-offset data-theme",
    "ol": "type start class id data-list-style",
    "ul": "class id",
    "li": "class id value",
    "input": "type class placeholder aria-label aria-describedby role disabled readonly",
    "button": "type class aria-label disabled",
}
ALLOWED_SCHEMES = ("http", "https", "mailto")
BLOCK_TAGS = ("p", "li", "td", "blockquote", "dt", "dd")
LOCATE_TAGS = ("p", "li", "td", "th", "dd", "blockquote")
INLINE_TAGS = ("b", "i", "em", "strong", "span", "u", "s", "sub", "sup")
RESERVED_IDS = ("main-content", "toc-heading", "search-help")

# Table settings.
HEADER_MODES = ("auto", "first_row", "title_row", "none")
ALIGN_MODES = ("auto", "left_all", "center_all", "right_all", "right_numeric", "auto_skip_first")
PLACE_MODES = ("auto", "full", "center", "left", "right")
PLACE_CLASSES = {
    "full": "manual-table-full", "center": "manual-table-center",
    "left": "manual-table-left", "right": "manual-table-right",
}
# Kinds of reviewer edit, and archive limits.
EDIT_KINDS = (
    "reference_edits", "reference_validations", "reference_reviewed",
    "reference_link_targets", "reference_ignored", "reference_external_urls",
)
MAX_ARCHIVE_BYTES = 200 * 1024 * 1024
MAX_ARCHIVE_FILES = 5000
