"""Style rules as data: name -> kind, level, scope, flags and patterns.

The patterns are fixed values: they are the vocabulary that the rules are about. Names of one organisation's own products and hosts are
parameters (`brand_terms`, `legacy_hosts` of `rules.rules`), not part of the table.
"""

# Fixed values ---------------------------------------------------------------------------------------------------------------------
EXISTENCE = {
    "AcronymPlural": ("error", "text", "nonword", [r"\b[A-Z]{2,5}'s\b(?: are| were| include)", r"\b(?:URL|API|SDK|UI|ID|JSON|CDN)'s\b"]),
    "AndOr": ("error", "text", "ignorecase", ["and/or"]),
    "Editorializing": (
        "error", "text", "ignorecase",
        ["powerful", "seamless(?:ly)?", "robust", "world.class", "best.in.class", "cutting.edge", "state.of.the.art", "blazing(?:ly)? fast", "effortless(?:ly)?", "game.chang(?:ing|er)", "rich(?:ly)? featured", "simply", "quickly and easily"],
    ),
    "EmDash": ("error", "text", "nonword", [r"\x{2014}", r"\s--\s"]),
    "EndpointInCode": ("warning", "text", "nonword", [r"(?:^|\s)/(?:v\d+/)?[a-z][a-z0-9-]{2,}(?:/\{?[a-zA-Z_][a-zA-Z0-9_-]*\}?)+"]),
    "Exclamation": ("error", "text", "nonword", [r"\w!(?:\s|$)", "!{2,}"]),
    "FileTypes": ("warning", "text", "nonword", [r"\s\.(?:PNG|JPG|JPEG|GIF|SVG|PDF|ZIP|JSON|CSV|MP4|MOV)\b", r"\ba \.(?:png|jpg|jpeg|gif|svg|pdf|zip|json|csv|mp4|mov) file\b"]),
    "Filler": ("warning", "text", "ignorecase", ["simply", "easily", "obviously", "of course", "it is trivial", "it's trivial", "straightforward(?:ly)?", "needless to say", "as everyone knows"]),
    "FirstPerson": ("warning", "text", "ignorecase", ["we'll", "we've", "we're", "let's", "we recommend", "our recommendation", "in our experience"]),
    "ForwardSlash": ("warning", "text", "nonword", [r"\b[a-z]{3,}/[a-z]{3,}\b"]),
    "HTTPMethodCase": ("error", "text", "nonword", [r"\b(get|post|put|patch|delete|head|options)\s+/[A-Za-z0-9{]", r"\b(?:a|an|the)\s+(get|post|put|patch|delete)\s+request\b"]),
    "HeadingPunctuation": ("error", "heading", "nonword", [r"[.!;:]\s*$"]),
    "LinkText": ("error", "raw", "nonword", [r"\[(?i:click here|here|this link|this page|this document|this guide|read more|learn more|more|link|this)\]\("]),
    "Measurements": ("warning", "text", "nonword", [r"\b\d+(?:KB|MB|GB|TB|kb|mb|gb|tb|px|ms|fps)\b", r"\b\d+\s+%"]),
    "NoteThat": ("suggestion", "text", "ignorecase", ["note that", "please note", "it should be noted", "keep in mind that", "bear in mind that"]),
    "Placeholders": ("error", "text", "nonword", [r"\{[A-Za-z][A-Za-z0-9_-]*\}", "<[a-z][a-z0-9_-]*>", r"\[[A-Z][A-Z0-9_]+\]", r"\bYOUR_[A-Z0-9_]+\b", r"\bMY_[A-Z0-9_]+\b", r"\bx{4,}\b"]),
    "Please": ("warning", "text", "ignorecase", ["please"]),
    "Semicolon": ("suggestion", "text", "nonword", [r"\w;\s"]),
    "StatusCodeName": (
        "warning", "text", "nonword",
        [r"\b[1-5]\d{2}\s+(?:ok|created|accepted|no content|moved permanently|found|not modified|bad request|unauthorized|forbidden|not found|method not allowed|conflict|gone|payload too large|unprocessable entity|too many requests|internal server error|bad gateway|service unavailable|gateway timeout)\b"],
    ),
    "TimelessDocs": (
        "warning", "text", "ignorecase",
        ["currently", "at (?:this|the present) time", "as of this writing", "at the moment", "recently", "soon", "eventually", "in the near future", "does not yet", "doesn't yet", "for now", "the latest version of", "newly (?:added|released|launched)", "coming soon"],
    ),
}
SUBSTITUTION = {
    "ActionVerbs": (
        "warning", "text", "ignorecase",
        {"navigate to": "go to", "head to": "go to", "hit the (?:endpoint|API)": "call the endpoint", "ping the (?:endpoint|API)": "call the endpoint", "invoke the endpoint": "call the endpoint", "grab the": "retrieve the", "fetch the (?:token|data|response)": "retrieve the", "type in": "enter", "key in": "enter", "input your": "enter your", "turn on": "enable", "turn off": "disable", r"log in\b": "sign in", "logging in": "signing in", r"log out\b": "sign out", r"\blogout\b": "sign out", "give back": "return", "send back": "return"},
    ),
    "AllowsYouTo": ("suggestion", "text", "ignorecase", {"allows you to": "lets you", "allow you to": "let you", "enables you to": "lets you", "permits you to": "lets you", "gives you the ability to": "lets you"}),
    "ApiKeyCase": ("error", "text", "", {"API Key(s)?": "API key", "Api Key(s)?": "API key", "Api key(s)?": "API key", "api key(s)?": "API key", "api Key(s)?": "API key", "API KEY(S)?": "API key"}),
    "DataTypes": (
        "error", "table.cell", "",
        {r"\bString\b": "string", r"\bstr\b": "string", r"\bInt64\b|\bi64\b": "int64", r"\bInt32\b|\bi32\b": "int32", r"\binteger\b|\bInteger\b": "int64", r"\bfloat\b|\bFloat\b|\bdecimal\b": "double", r"\bbool\b|\bboolean\b|\bBOOL\b": "Boolean", r"\bArray\b": "list<...>", r"\[\]string": "list<string>", r"\bObject\b": "object", r"\bdict\b|\bstruct\b": "object"},
    ),
    "DirectionalLanguage": (
        "error", "text", "ignorecase",
        {"the (?:image|table|diagram|example|code|list|section) below": "the following", "the (?:image|table|diagram|example|code|list|section) above": "the preceding", "see (?:the )?below": "see the following", "see (?:the )?above": "see the preceding", "shown below": "shown in the following", "to the right": "the following", "to the left": "the preceding", "on the left.hand side": "the preceding", "on the right.hand side": "the following"},
    ),
    "GenderNeutral": ("error", "text", "ignorecase", {"he/she": "they", "s/he": "they", "his/her": "their", "him/her": "them", r"\(s\)he": "they", "his or her": "their", "he or she": "they"}),
    "InclusiveLanguage": (
        "error", "text", "ignorecase",
        {"white[- ]?list(s|ed|ing)?": "allowlist", "black[- ]?list(s|ed|ing)?": "denylist", "master/slave": "primary/replica", "slave (node|server|database)": "replica", "sanity check": "consistency check", "dummy (value|data|variable)": "placeholder value", "grandfathered": "legacy", "crazy": "unexpected", "insane": "unexpected", "blind(ly)? (call|invoke|retry)": "unconditional", r"\bdumb\b": "unclear", "cripple(s|d)?": "disable", r"\bnative speaker": "first-language speaker"},
    ),
    "LatinAbbreviations": ("warning", "text", "nonword", {r"\be\.g\.(?:,)?": "for example", r"\bi\.e\.(?:,)?": "that is", r"\betc\.": "and so on", r"\bvs\.": "versus", r"\bN\.B\.": "note"}),
    "ProductTerms": (
        "error", "text", "",
        {r"\bDev Portal\b|\bdeveloper portal\b": "Developer Portal", r"\bMini App\b|\bminiapp\b|\bmini-app\b": "mini app", r"\bMini Game\b|\bminigame\b|\bmini-game\b": "mini game", r"\bMini Drama\b|\bmini-drama\b": "mini drama", r"\baccessToken\b|\bAccessToken\b|\bAccess Token\b": "access token", r"\brefreshToken\b|\bRefreshToken\b|\bRefresh Token\b": "refresh token", r"\bclientKey\b|\bClient Key\b": "client key", r"\bclientSecret\b|\bClient Secret\b": "client secret", r"\bcallback URL\b|\bredirect URL\b": "redirect URI", r"\bweb hook\b|\bWebhook\b": "webhook", r"\bSandbox\b": "sandbox", r"\btest mode\b": "sandbox", r"\bApp Review\b": "app review", r"\bApp Page\b": "app page", r"\borg admin\b": "organization admin"},
    ),
    "RequirementKeywords": ("error", "text", "ignorecase", {"you may (?:optionally )?": "you can", "users? may ": "users can", "you need to": "you must", "you have to": "you must", "you are required to": "you must", "you'll need to": "you must", "it is necessary to": "you must", "it is mandatory to": "you must"}),
    "ScreenComponents": (
        "error", "text", "ignorecase",
        {"drop.down menus?": "dropdown", "drop.downs?": "dropdown", "left.hand navigation": "left navigation panel", "left navigation (?:bar|menu)": "left navigation panel", "navigation bar menu": "main navigation bar", "navigation menu": "main navigation bar", "radio buttons?": "option", r"check the (\w+) checkbox": "select the $1 checkbox", "uncheck": "deselect", "unclick": "deselect", "tick the": "select the"},
    ),
    "Terminology": (
        "error", "text", "",
        {"Javascript|JavaScipt|Java Script": "JavaScript", "Typescript|TypeScipt": "TypeScript", r"NodeJS|Node\.JS|node\.js": "Node.js", "Github|GitHUB": "GitHub", "Json|JSon": "JSON", "Yaml(?: |$)": "YAML", "Url(?:s)?(?: |$)": "URL", "Uri(?: |$)": "URI", "Http(?:s)?(?: |$)": "HTTP", "Sdk(?:s)?(?: |$)": "SDK", "Api(?:s)?(?: |$)": "API", "Cli(?: |$)": "CLI", "Uuid(?: |$)": "UUID", "Jwt(?: |$)": "JWT", r"\bOauth\b|\boauth\b|\bOAuth2(?:\.0)?\b": "OAuth 2.0", "web hook(s)?": "webhook", "web site(s)?": "website", "e-mail(s)?": "email", "data base(s)?": "database", "MacOS|Mac OS X|Mac OS": "macOS", "IOS(?: |$)|Ios(?: |$)": "iOS", "internet explorer": "Internet Explorer"},
    ),
    "UIActions": ("error", "text", "ignorecase", {"click on": "click", "tap on": "tap", "press on": "press", "click the button labeled": "click", "right click": "right-click"}),
    "VagueWords": ("warning", "text", "ignorecase", {r"\bvia\b": "through", r"the desired (\w+)": "the $1 you want", r"\bdesired\b": "the one you want", r"\babort\b": "stop", r"\bkill\b": "stop", r"\bterminate\b": "end", "man.hours": "person-hours", "manpower": "staffing"}),
    "Wordiness": (
        "warning", "text", "ignorecase",
        {"in order to": "to", "in order for": "for", "at this point in time": "now", "at the present time": "now", "due to the fact that": "because", "in the event that": "if", "for the purpose of": "for", "prior to": "before", "subsequent to": "after", "in the case of": "for", "a (?:large )?number of": "many", "the majority of": "most", "utilize[sd]?": "use", "leverage[sd]?": "use", "is able to": "can", "are able to": "can", "has the ability to": "can", "make use of": "use"},
    ),
}
SENTENCE_LENGTH = ("suggestion", 40, r"(?U)\b\w+\b")
ACRONYM = ("suggestion", r"\b([A-Z]{3,5})\b", r"(?:\b[A-Za-z][A-Za-z.-]+[ ]){1,5}\(([A-Z]{3,5})\)")
HEADING_CASE = {"HeadingCaseH1": ("error", "title"), "HeadingCaseH2Plus": ("warning", "sentence")}
LEGACY_HOST_LEVEL = "error"
# ----------------------------------------------------------------------------------------------------------------------------------

#: Names that stay as they are in headings and need no definition; a doc set brings its own list as `vocabulary`.
VOCABULARY = ["AND", "API", "CLI", "CSS", "CSV", "DNS", "GET", "HTML", "HTTP", "HTTPS", "JSON", "JWT", "NOT", "OAuth", "PATCH", "PDF", "POST", "PUT", "REST", "SDK", "SQL", "SSL", "TLS", "URI", "URL", "UTC", "UTF", "UUID", "XML", "YAML", "GitHub", "JavaScript", "Node.js", "Python", "TypeScript"]
#: Words that title case leaves small: articles, short conjunctions and prepositions.
SMALL_WORDS = ["a", "an", "and", "as", "at", "but", "by", "for", "from", "if", "in", "into", "nor", "of", "off", "on", "or", "per", "so", "the", "to", "up", "via", "with", "yet"]
