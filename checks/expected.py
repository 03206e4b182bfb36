"""What the SQL twins hold the engine against: its fixed values, written down a second time."""


# Elements without content.
VOID_TAGS = [
    "br", "img", "meta", "link", "input", "hr", "area", "source", "base", "col", "embed", "param", "track", "wbr",
]

# Elements that end a paragraph.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
]

# Which start tags end an element.
IMPLIED_ENDS = {
    "li": ["li"],
    "dt": ["dt", "dd"],
    "dd": ["dt", "dd"],
    "option": ["option"],
    "head": ["body"],
    "td": ["td", "th", "tr", "tbody", "tfoot"],
    "th": ["td", "th", "tr", "tbody", "tfoot"],
    "tr": ["tr", "tbody", "tfoot"],
    "thead": ["tbody", "tfoot"],
    "tbody": ["tbody", "tfoot"],
}

# Elements without article text.
USELESS_TAGS = [
    "style", "script", "link", "video", "iframe", "source", "picture", "header",
]

# Class words of parts without article text.
USELESS_CLASS_WORDS = [
    "share", "contribution", "copyright", "disclaimer", "recommend", "related", "footer", "comment", "social", "submeta",
]

# Elements dropped when empty.
DROPPED_WHEN_EMPTY = [
    "section", "h1", "h2", "h3", "h4", "h5", "h6", "span",
]

# Inline elements that selectors climb out of.
CLIMBED_TAGS = [
    "strong", "font", "i",
]

# Patterns of authors, in order.
AUTHOR_PATTERNS = [
    r"(作者[：|:| |丨|/] *[一-龥a-zA-Z0-9、 ]{2,20})[）】\)\]]?[^一-龥|:|：]",
    r"(原创[：|:| |丨|/] *[一-龥a-zA-Z0-9、 ]{2,20})[）】\)\]]?[^一-龥|:|：]",
    r"(撰文[：|:| |丨|/] *[一-龥a-zA-Z0-9、 ]{2,20})[）】\)\]]?[^一-龥|:|：]",
    r"(文/图[：|:| |丨|/]? *[一-龥a-zA-Z0-9、 ]{2,20})[）】\)\]]?[^一-龥|:|：]",
]

# Patterns of editors, in order.
EDITOR_PATTERNS = [
    r"(责任编辑[：|:| |丨|/] *[一-龥a-zA-Z0-9、 ]{2,20})[）】\)\]]?[^一-龥|:|：]",
    r"(编辑[：|:| |丨|/] *[一-龥a-zA-Z0-9、 ]{2,20})[）】\)\]]?[^一-龥|:|：]",
    r"(责编[：|:| |丨|/] *[一-龥a-zA-Z0-9、 ]{2,20})[）】\)\]]?[^一-龥|:|：]",
    r"(记者[：|:| |丨|/] *[一-龥a-zA-Z0-9、 ]{2,20})[）】\)\]]?[^一-龥|:|：]",
]

# Patterns of sources.
SOURCE_PATTERNS = [
    r"来源于?[：|:| |丨|/|]\s*([一-龥a-zA-Z0-9、 -－]{2,20})[）】\)\]]?[^一-龥|:|：]",
]

# Date layouts, in order.
DATE_PATTERNS = [
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[0-1]?[0-9]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[2][0-3]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[0-1]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[2][0-3]:[0-5]?[0-9])",
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[1-24]\d时[0-60]\d分)([1-24]\d时)",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[0-1]?[0-9]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[2][0-3]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[0-1]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[2][0-3]:[0-5]?[0-9])",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[1-24]\d时[0-60]\d分)([1-24]\d时)",
    r"(\d{4}年\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}年\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}年\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}年\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9])",
    r"(\d{4}年\d{1,2}月\d{1,2}日\s*?[1-24]\d时[0-60]\d分)([1-24]\d时)",
    r"(\d{2}年\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}年\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}年\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}年\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9])",
    r"(\d{2}年\d{1,2}月\d{1,2}日\s*?[1-24]\d时[0-60]\d分)([1-24]\d时)",
    r"(\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9])",
    r"(\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9])",
    r"(\d{1,2}月\d{1,2}日\s*?[1-24]\d时[0-60]\d分)([1-24]\d时)",
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2})",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2})",
    r"(\d{4}年\d{1,2}月\d{1,2}日)",
    r"(\d{2}年\d{1,2}月\d{1,2}日)",
    r"(\d{1,2}月\d{1,2}日)",
]

# Every built-in rule as (field, kind, patterns in order).
DEFAULTS = [
    ("channel", "pattern", [r"[一-龥a-zA-Z]{2,20}\s*[>→]{1,2}\s*[一-龥a-zA-z]{2,20}"]),
    ("title", "pattern", ["[-_|]"]),
    ("author", "pattern", AUTHOR_PATTERNS),
    ("editor", "pattern", EDITOR_PATTERNS),
    ("video_url", "pattern", ["mp4|AVI|mov|rmvb|rm|FLV|3GP"]),
    ("source", "pattern", SOURCE_PATTERNS),
    ("publish_date", "pattern", DATE_PATTERNS),
    ("noise_node", "noise", ['//*[@class="comment-list"]']),
]

# Named entities, the ampersand last, and the punctuation marks that count.
ENTITIES = [
    ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&middot;", "·"), ("&bull;", "•"),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&laquo;", "«"), ("&raquo;", "»"), ("&times;", "×"), ("&deg;", "°"),
    ("&euro;", "€"), ("&yen;", "¥"), ("&amp;", "&"),
]
PUNCTUATION = "！，。？、；：“”‘’《》%（）,.?:;'\"!()"
