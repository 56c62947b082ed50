"""Fixed values.

Word lists, limits, patterns and text formats that results depend on. They are kept
together and in natural order; everything else in the package is derived from them.
"""

# ECMAScript white space, as the inside of a regex character class. Characters past Latin-1 are
# tested behind one range check, which keeps the class cheap for ordinary text.
WS_WIDE = r"[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
WS = r"\t\n\x0B\f\r \x{00A0}" + WS_WIDE
# The characters themselves.
WS_CHARACTERS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# The same without the line feed, for patterns that work line by line.
WS_LINE = r"\t\x0B\f\r \x{00A0}" + WS_WIDE

PUNCTUATION = ".,!?;:"

# Elements that carry page chrome rather than content.
SKIP_TAGS = ["nav"]
SKIP_ROLES = ["navigation", "banner", "contentinfo"]
SKIP_CLASSES = ["navigation", "nav", "menu", "footer", "sidebar", "comments", "advertisement", "social-share"]

# Content containers in priority order.
CONTENT_SELECTORS = [
    "#readme article", ".markdown-body", "#readme",
    "[itemprop=articleBody]",
    "main", "article", "[role=main]",
    "#main-content", ".main-content", ".post-content", ".post-body",
    ".article-content", ".article-body", ".entry-content", ".content",
    "#content", ".page-content", ".site-content", ".body-content",
    "[data-content]", ".container > section", "section.content",
]
CONTENT_MIN_CHARS = 100
DENSITY_TAGS = ["div", "section", "article"]
DENSITY_MIN_PARAGRAPHS = 2
DENSITY_MIN_CHARS = 200
FALLBACK_TAGS = ["section", "main", "article"]

HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCK_TAGS = HEADING_TAGS + ["p", "ul", "ol", "pre", "code", "table"]

# Marks around formatted text, by element.
INLINE_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "s": "~~", "del": "~~"}

CODE_LANGUAGE_CLASS = r"(?i)(?:language|lang|brush)-(\w+)"
CODE_LANGUAGE_ATTRIBUTES = ["data-language", "data-lang", "data-code-language"]

# File names.
SLUG_MAX = 35
SLUG_FALLBACK = "page"
FILE_NAME_FALLBACK = "page-content"
TITLE_ILLEGAL = r'[/\\?%*:|"<>]'
TITLE_MAX = 80
TITLE_FALLBACK = "untitled"
ANCHOR_MAX = 80
MODE_EXTENSIONS = {"json": ".json", "xml": ".xml", "md": ".md"}

# Model context limits, in tokens.
MODEL_LIMITS = [("gpt-4", 8_192), ("gpt-4o", 128_000), ("claude", 200_000), ("gemini", 1_000_000)]

# Page trees.
TREE_CAP = 100
TREE_TYPES = ["page", "folder"]
PAGE_TITLE_DEFAULT = "Untitled"
FOLDER_TITLE_DEFAULT = "Untitled folder"
WIKI_HOST = r"(?i)\.atlassian\.net\z"
WIKI_PAGE_PATH = r"/wiki/spaces/[^/]+/pages/([0-9]+)"
WIKI_FOLDER_PATH = r"/wiki/spaces/[^/]+/folder/([0-9]+)"
WIKI_BODY_PATH = ("/wiki/api/v2/pages/", "?body-format=export_view")
FOLDER_NOTE = "_(Confluence folder — no page body)_"
SKIPPED_PATH = "_skipped.txt"
SKIPPED_HEADER = "Pages skipped during export (permission denied, not found, or fetch failed):"

SESSION_HEADING = "# Research Session — "
SESSION_DATE_FORMAT = "MMMM d, yyyy"

# Markdown files and nesting.
MARKDOWN_FILE = r"(?i)\.(md|markdown|mdown|mkd)\z"
MARKDOWN_MAX_DEPTH = 100
MARKDOWN_GLOB = "*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN],[mM][dD][oO][wW][nN],[mM][kK][dD]}"

# Character references to 128-159 mean the characters of Windows-1252, where it has one.
HIGH_CONTROLS = [ord(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(128, 160)]
