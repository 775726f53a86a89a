"""Markers of rendered token streams, token lists and other values that are fixed by the data format."""

# Markers of the rendered text.
COMMENT, STRING, IDENTIFIER = "<comment>", "<str_literal>", "<identifier>"
WORD_START, WORD_END, CAPITAL, CAPITALS = "`w", "w`", "`C", "`Cs"
VAR, STRING_RESOURCE, END, NON_ENG, NON_ENG_CONTENT = "<var>", "<str_res>", "``", "`E", "`Es"
LOG, LOG_END, BLOCK, BLOCK_END, PAD, LINE_COMMENT_END = "`L", "L`", "`l", "l`", "<pad>", "m`"
LEVELS = ["trace", "debug", "info", "warn", "error", "fatal", "unknown"]
LEVEL_MARK = {level: f"`{level}" for level in LEVELS}
LOGGING = [LOG, LOG_END, BLOCK, BLOCK_END, *LEVEL_MARK.values()]
READABLE = {COMMENT: COMMENT, STRING: STRING, IDENTIFIER: IDENTIFIER, VAR: VAR, STRING_RESOURCE: STRING_RESOURCE, END: "\n\n", NON_ENG_CONTENT: "<non_eng_content>", NON_ENG: "<non_eng>", PAD: PAD}
ALL = [COMMENT, STRING, IDENTIFIER, WORD_START, WORD_END, CAPITAL, CAPITALS, VAR, STRING_RESOURCE, END, NON_ENG, NON_ENG_CONTENT, PAD, LINE_COMMENT_END, *LOGGING]

# Names of loggers and, by level, of their methods, as patterns in the order in which they are tried.
LOGGER = "[Ll]og|LOG|[Ll]ogger|LOGGER"
METHODS = {
    "trace": "[Tt]race|TRACE|v|t|logV|[Ff]inest|FINEST",
    "debug": "[Dd]ebug|DEBUG|d|logD|[Ff]iner|FINER|[Cc]onfig|CONFIG",
    "info": "[Ii]nfo|INFO|i|logI|[Ff]ine|FINE",
    "warn": "[Ww]arn|WARN|[Ww]arning|WARNING|w|logW",
    "error": "[Ee]rror|ERROR|e|logE",
    "fatal": "[Ff]atal|FATAL|[Ss]evere|SEVERE|s|f",
}
POSITIVE_LEVELS = ["trace", "debug", "info"]
#: Tokens after the opening bracket of a log call, the closing one included.
LOG_LENGTH = 40

# Delimiters by length, and the keywords.
COMMENT_MARKS = ["/*", "*/"]
TWO_SIGNS = "== != ** // ++ -- += -= /= *= %= <= >= ^= &= |= >> << && ||".split()
ONE_SIGN = "+ * ! / > < =".split()
ONE_SIGN_VERBOSE = "{ } [ ] , . - ? : ( ) ; \" & | \\ @ # $ ' ~ % ^".split()
KEYWORDS = (
    "abstract assert boolean break byte case catch char class continue default do double else enum extends false final finally float for if implements import instanceof int interface long native new null package private "
    "protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while"
).split()
STOP_WORDS = "a an and are as at be for has in is it its of on that the to was were with".split()
NUMBER = r"-?(?:0x[0-9a-fA-F]+[lL]?|[0-9]+[lL]?|(?:[0-9]*\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?[fFdD]?)"
