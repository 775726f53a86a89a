"""Bundled grammars for grammar_engine: Java 17, JavaScript (script), Python 3, XML 1.0, JSON.

The grammars are written for a parser that follows all readings at once, so casts, lambda heads, generic
brackets, contextual keywords and assignment targets are told apart by the grammar alone; only regular
expressions, layout and Python's soft keywords are settled by the lexers in ``lexers.py``. They are wider
than the languages where a rule isn't one of form: precedence of operators, repeated modifiers, names declared
twice, ``break`` outside a loop.
"""

import re

#: Words that are names where they aren't keywords.
SOFT = {"java": ("record", "sealed", "permits", "yield", "module", "open"), "js": ("async", "let", "static", "get", "set", "of", "yield", "await")}

_BIN = "'+'|'-'|'*'|'/'|'%'|'=='|'!='|'<'|'<='|'>='|'&&'|'||'|'&'|'|'|'^'|'<<'|'>' ['>' ['>']]"
_ASSIGN = "'='|'+='|'-='|'*='|'/='|'%='|'&='|'|='|'^='|'<<='|'>>='|'>>>='"
# Parts of an expression: heads and suffixes that end in a variable, in a call, or in neither.
_CALLED = "ID args | [targs] ('this'|'super') args | 'new' creator"
_START = f"ID | {_CALLED} | NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | '(' expr ')' | lambda | ('void'|prim) ('[' ']')* '.' 'class' | typeref | 'super'"
_HEAD = f"{_START} | 'switch' paren '{{' armed* '}}'"
_VARIABLE = "'.' ID | '[' expr ']'"
_CALL = "'.' [targs] (ID|'super') args | '.' 'new' creator"
_SUFFIX = f"{_VARIABLE} | {_CALL} | '.' ('this'|'class'|'super') | '::' [targs] (ID|'new') | '++' | '--'"
_CAST = "'(' prim ('[' ']')* ')' operand | '(' type ('&' type)* ')' plain"
_OPERAND = f"('+'|'-'|'!'|'~'|'++'|'--') operand | {_CAST} | ({_HEAD}) ({_SUFFIX})*"
_REST = f"(({_BIN}) operand | 'instanceof' ('final' | annotation)* type [ID])*"

JAVA = f"""
file: [annotation* 'package' name ';'] (importdecl | ';')* (modifier* typedecl | ';')* [moduledecl] EOF
importdecl: 'import' ['static'] ID ('.' ID)* ['.' '*'] ';'
moduledecl: annotation* ['open'] 'module' name '{{' ((ID | 'static' | 'open' | '.' | ',')+ ';')* '}}'
name: ID ('.' ID)*
typedecl: 'class' ID [tparams] ['extends' type] ['implements' types] ['permits' types] classbody
  | 'interface' ID [tparams] ['extends' types] ['permits' types] classbody | 'enum' ID ['implements' types] enumbody
  | '@interface' ID classbody | 'record' ID [tparams] params ['implements' types] classbody
modifier: 'public'|'private'|'protected'|'static'|'final'|'abstract'|'native'|'synchronized'|'transient'|'volatile'|'strictfp'|'default'|'sealed'|'non-sealed'|annotation
annotation: '@' name ['(' [value | ID '=' value (',' ID '=' value)*] ')']
value: operand {_REST} ['?' expr ':' expr] | annotation | '{{' [value (',' value)*] [','] '}}'
types: type (',' type)*
type: annotation* (ID [targs] ('.' annotation* ID [targs])* | prim) (annotation* '[' ']')*
prim: 'int'|'long'|'short'|'byte'|'char'|'boolean'|'float'|'double'
targs: '<' [targ (',' targ)*] '>'
targ: type | annotation* '?' [('extends'|'super') type]
tparams: '<' tparam (',' tparam)* '>'
tparam: annotation* ID ['extends' type ('&' type)*]
classbody: '{{' member* '}}'
enumbody: '{{' [constant (',' constant)*] [','] [';' member*] '}}'
constant: annotation* ID [args] [classbody]
member: ';' | ['static'] block | modifier* ( typedecl | [tparams] ('void' | type) ID params (annotation* '[' ']')* ['throws' types] (block | 'default' value ';' | ';')
  | type variables ';' | [tparams] ID params ['throws' types] block | ID block )
variables: ID (annotation* '[' ']')* ['=' init] (',' ID (annotation* '[' ']')* ['=' init])*
init: expr | '{{' [init (',' init)*] [','] '}}'
params: '(' [param (',' param)*] ')'
param: ('final' | annotation)* type ([annotation* '...'] ID ('[' ']')* | (ID '.')* 'this')
block: '{{' item* '}}'
item: statement | ('final' | 'abstract' | 'strictfp' | annotation)* typedecl | ('final' | annotation)* type variables ';'
statement: block | ';' | 'if' paren statement ['else' statement] | 'while' paren statement | 'do' statement 'while' paren ';' | 'for' '(' forhead ')' statement
  | 'return' [expr] ';' | 'break' [ID] ';' | 'continue' [ID] ';' | 'throw' expr ';' | 'assert' expr [':' expr] ';' | 'synchronized' paren block
  | 'try' ( '(' resource (';' resource)* [';'] ')' block catch* ['finally' block] | block (catch+ ['finally' block] | 'finally' block) )
  | 'switch' paren '{{' group* '}}' | 'yield' expr ';' | ID ':' statement | effect ';'
catch: 'catch' '(' ('final' | annotation)* type ('|' type)* ID ')' block
resource: ('final' | annotation)* type ID '=' expr | expr
forhead: ('final' | annotation)* type ID ':' expr | [('final' | annotation)* type variables | effects] ';' [expr] ';' [effects]
effects: effect (',' effect)*
effect: ('++'|'--') operand | (ID | '(' expr ')' | ({_START}) ({_SUFFIX})* ({_VARIABLE})) (({_ASSIGN}) expr | '++' | '--') | {_CALLED} | ({_START}) ({_SUFFIX})* ({_CALL})
labels: 'case' label (',' label)* | 'default'
label: operand {_REST} ['?' expr ':' expr] [ID] | 'default'
group: labels (':' item* | '->' (effect ';' | block | 'throw' expr ';'))
armed: labels (':' item* | '->' (expr ';' | block | 'throw' expr ';'))
paren: '(' expr ')'
expr: (ID | '(' expr ')' | ({_HEAD}) ({_SUFFIX})* ({_VARIABLE})) ({_ASSIGN}) expr | ({_OPERAND}) {_REST} ['?' expr ':' expr]
operand: {_OPERAND}
plain: ('!'|'~') operand | {_CAST} | ({_HEAD}) ({_SUFFIX})*
typeref: ID [targs] ('.' annotation* ID [targs])* ('[' ']')* '::' (ID | 'new') | ID ('.' ID)* ('[' ']')+ '.' 'class' | prim ('[' ']')+ '::' (ID | 'new')
lambda: (ID | '(' [ID (',' ID)*] ')' | params) '->' (expr | block)
creator: annotation* [targs] annotation* ( ID [targs] ('.' annotation* ID [targs])* args [classbody] | (ID [targs] ('.' annotation* ID [targs])* | prim) ((annotation* '[' expr ']')+ (annotation* '[' ']')* | (annotation* '[' ']')+ '{{' [init (',' init)*] [','] '}}') )
args: '(' [expr (',' expr)*] ')'
"""

_WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with true false null enum"
_WORD = "|".join(f"'{w}'" for w in _WORDS.split())
_JBIN = "'+'|'-'|'*'|'/'|'%'|'**'|'=='|'!='|'==='|'!=='|'<'|'>'|'<='|'>='|'&&'|'||'|'??'|'&'|'|'|'^'|'<<'|'>>'|'>>>'|'instanceof'|'in'"
_JASSIGN = "'='|'+='|'-='|'*='|'/='|'%='|'**='|'&='|'|='|'^='|'<<='|'>>='|'>>>='|'&&='|'||='|'??='"
_FIELD = f"('.'|'?.') (ID | PRIVATE | {_WORD}) | '[' expr~ ']'"
_JSUFFIX = f"{_FIELD} | '?.' (args~ | '[' expr~ ']' | template~) | args~ | template~"
_JSTART = "'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | REGEX | template~ | ID | array~ | '(' expr~ ')' | 'import' args~ | 'new' ('.' ID | newhead~)"
_JHEAD = f"{_JSTART} | function | class~ | object~"
_PREFIX = "'delete'|'void'|'typeof'|'+'|'-'|'~'|'!' @await"
_STEP = "('++'|'--'|'N++'|'N--') place~"


def _assign(heads: str) -> str:
    """An assignment, a conditional or a chain of operators that starts with one of ``heads``."""
    return (
        f"(ID | array~ | ({heads}) ({_JSUFFIX})* ({_FIELD})) ({_JASSIGN}) assign~ | (({_PREFIX}) unary~ | {_STEP} | ({heads}) ({_JSUFFIX})* ['++'|'--'] | PRIVATE 'in' unary~)"
        f" (({_JBIN}) (unary~ | PRIVATE 'in' unary~))* ['?' assign~ ':' assign~] | arrow @yield"
    )


# ``~`` stands for the kind of function the rules are in: t none, f plain, a async, g generator, b both.
_KIND = f"""
item~: statement~ | ('const' | 'let') bindings~ ';' | 'class' ID classtail~
statement~: block~ | 'var' bindings~ ';' | ';' | 'if' paren~ statement~ ['else' statement~] | 'do' statement~ 'while' paren~ [';'] | 'while' paren~ statement~
  | 'for' @for '(' forhead~ ')' statement~ | 'continue' [ID] ';' | 'break' [ID] ';' | 'with' paren~ statement~ | 'throw' expr~ ';' | 'debugger' ';' | declared | ID ':' statement~ @return
  | 'switch' paren~ '{{' (('case' expr~ | 'default') ':' item~*)* '}}' | 'try' block~ ('catch' ['(' target~ ')'] block~ ['finally' block~] | 'finally' block~) | first~ (',' assign~)* ';'
first~: {_assign(_JSTART)}
body~: {_assign(_JSTART + ' | function | class~')}
block~: '{{' item~* '}}'
paren~: '(' expr~ ')'
bindings~: target~ ['=' assign~] (',' target~ ['=' assign~])*
target~: ID | '[' ','* [element~ (','+ element~)* ','*] ']' | '{{' [bound~ (',' bound~)* [',']] '}}'
element~: ['...'] target~ ['=' assign~]
bound~: '...' ID | ID ['=' assign~] | key~ ':' target~ ['=' assign~]
key~: ID | {_WORD} | STR | NUM | '[' assign~ ']'
forhead~: ['var' | 'let' | 'const'] ( target~ | lhs~ ) ('of' assign~ | 'in' expr~) | [('var' | 'let' | 'const') bindings~ | expr~] ';' [expr~] ';' [expr~]
lhs~: ({_JHEAD}) ({_JSUFFIX})* ({_FIELD})
expr~: assign~ (',' assign~)*
assign~: {_assign(_JHEAD)} | object~ '=' assign~
place~: ID | '(' expr~ ')' | ({_JHEAD}) ({_JSUFFIX})* ({_FIELD})
unary~: ({_PREFIX}) unary~ | {_STEP} | ({_JHEAD}) ({_JSUFFIX})* ['++'|'--']
newhead~: ({_JHEAD}) ({_FIELD} | template~)*
template~: TPL | TPLHEAD expr~ (TPLMID expr~)* TPLTAIL
array~: '[' ','* [spread~ (','+ spread~)* ','*] ']'
spread~: ['...'] assign~
args~: '(' [spread~ (',' spread~)* [',']] ')'
object~: '{{' [member~ (',' member~)* [',']] '}}'
member~: '...' assign~ | ID ['=' assign~] | key~ ':' assign~ | method~
method~: [('get' | 'set')] key~ plainbody | '*' key~ generatorbody | 'async' key~ asyncbody | 'async' '*' key~ bothbody
class~: 'class' [ID] classtail~
classtail~: ['extends' ({_JHEAD}) ({_JSUFFIX})*] '{{' (';' | ['static'] (method~ | [('get' | 'set')] PRIVATE plainbody | '*' PRIVATE generatorbody | 'async' PRIVATE asyncbody | 'async' '*' PRIVATE bothbody | (key~ | PRIVATE) ['=' assignf] ';') | 'static' blockf)* '}}'
"""
_ONLY = {"@for": ("ab", "['await']"), "@await": ("ab", "|'await'"), "@yield": ("gb", "| 'yield' [['*'] assign~]"), "@return": ("fagb", "| 'return' [expr~] ';'")}


def _kind(k: str) -> str:
    text = _KIND
    for mark, (kinds, rule) in _ONLY.items():
        text = text.replace(mark, rule if k in kinds else "")
    return re.sub(r"(?<=\w)~", k, text)


JAVASCRIPT = "file: itemt* EOF" + "".join(map(_kind, "tfagb")) + """
declared: 'function' ID plainbody | 'function' '*' ID generatorbody | 'async' 'function' ID asyncbody | 'async' 'function' '*' ID bothbody
function: 'function' [ID] plainbody | 'function' '*' [ID] generatorbody | 'async' 'function' [ID] asyncbody | 'async' 'function' '*' [ID] bothbody
plainbody: '(' [elementf (',' elementf)* [',']] ')' blockf
generatorbody: '(' [elementg (',' elementg)* [',']] ')' blockg
asyncbody: '(' [elementa (',' elementa)* [',']] ')' blocka
bothbody: '(' [elementb (',' elementb)* [',']] ')' blockb
arrow: (ID | '(' [elementf (',' elementf)* [',']] ')') '=>' (bodyf | blockf) | 'async' (ID | '(' [elementa (',' elementa)* [',']] ')') '=>' (bodya | blocka)
"""

_PAUG = "'+='|'-='|'*='|'/='|'//='|'%='|'@='|'&='|'|='|'^='|'>>='|'<<='|'**='"

PYTHON = f"""
file: (NL | statement)* EOF
statement: simple | compound
simple: small (';' small)* [';'] NL
small: exprstmt | 'del' targets | 'pass' | 'break' | 'continue' | 'return' [starlist] | 'raise' [test ['from' test]]
  | 'import' dotted ['as' NAME] (',' dotted ['as' NAME])* | 'from' (dotted | ('.'|'...')+ [dotted]) 'import' importees
  | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)* | 'assert' test [',' test] | 'type' NAME [typeparams] '=' test
importees: '*' | '(' NAME ['as' NAME] (',' [NAME ['as' NAME]])* ')' | NAME ['as' NAME] (',' NAME ['as' NAME])*
dotted: NAME ('.' NAME)*
exprstmt: (targets '=')* (yield | starlist) | target (({_PAUG}) (yield | starlist) | ':' test ['=' (yield | starlist)])
targets: startarget (',' [startarget])*
startarget: ['*'] target
target: NAME | '(' [targets] ')' | '[' [targets] ']' | atom trailer* ('.' NAME | '[' subscript (',' [subscript])* ']')
compound: 'if' named ':' suite ('elif' named ':' suite)* ['else' ':' suite] | 'while' named ':' suite ['else' ':' suite]
  | 'for' targets 'in' starlist ':' suite ['else' ':' suite] | 'try' ':' suite ( ('except' ['*'] [test ['as' NAME]] ':' suite)+ ['else' ':' suite] ['finally' ':' suite] | 'finally' ':' suite )
  | 'with' withitems ':' suite | 'def' NAME [typeparams] '(' [params] ')' ['->' test] ':' suite | 'class' NAME [typeparams] ['(' [arglist] ')'] ':' suite
  | '@' named NL+ (compound) | 'async' compound | 'match' inner (',' [inner])* ':' NL INDENT casepart+ DEDENT
casepart: 'case' pattern (',' [pattern])* ['if' named] ':' suite
pattern: orpattern ['as' NAME]
orpattern: pat ('|' pat)*
pat: ['-'] NUM [('+'|'-') NUM] | STR+ | 'None' | 'True' | 'False' | '*' NAME | NAME ('.' NAME)* ['(' [patarg (',' [patarg])*] ')'] | '(' [pattern (',' [pattern])*] ')' | '[' [pattern (',' [pattern])*] ']' | '{{' [mapitem (',' [mapitem])*] '}}'
patarg: pattern ['=' pattern]
mapitem: '**' NAME | pat ':' pattern
typeparams: '[' typeparam (',' [typeparam])* ']'
typeparam: ('*'|'**') NAME | NAME [':' test]
withitems: withitem (',' withitem)* | '(' withitem (',' withitem)* [','] ')'
withitem: test ['as' target]
suite: simple | NL+ INDENT (statement | NL)+ DEDENT
params: NAME [':' test] ('=' test [',' [defaulted]] | [',' [params]]) | '/' [',' [params]] | starparams
defaulted: NAME [':' test] '=' test [',' [defaulted]] | '/' [',' [defaulted]] | starparams
starparams: '*' (NAME [':' startest] [',' [named_only]] | ',' named_only) | '**' NAME [':' test] [',']
named_only: NAME [':' test] ['=' test] [',' [named_only]] | '**' NAME [':' test] [',']
startest: ['*'] test
yield: 'yield' ['from' test | starlist]
starlist: starred (',' [starred])*
starred: '*' expr | test
inner: '*' expr | named
named: test [':=' test]
test: ortest ['if' ortest 'else' test] | lambda
lambda: 'lambda' [lparams] ':' test
lparams: NAME ('=' test [',' [ldefaulted]] | [',' [lparams]]) | '/' [',' [lparams]] | lstar
ldefaulted: NAME '=' test [',' [ldefaulted]] | '/' [',' [ldefaulted]] | lstar
lstar: '*' [NAME] [',' [lnamed]] | '**' NAME [',']
lnamed: NAME ['=' test] [',' [lnamed]] | '**' NAME [',']
ortest: nottest (('and'|'or') nottest)*
nottest: 'not' nottest | comparison
comparison: expr (('<'|'>'|'=='|'>='|'<='|'!='|'in'|'not' 'in'|'is' ['not']) expr)*
expr: factor (('|'|'^'|'&'|'<<'|'>>'|'+'|'-'|'*'|'/'|'%'|'//'|'@') factor)*
factor: ('+'|'-'|'~') factor | ['await'] atom trailer* ['**' factor]
atom: '(' [yield | inlist] ')' | '[' [inlist] ']' | '{{' [dictorset] '}}' | NAME | NUM | (STR field*)+ | '...' | 'None' | 'True' | 'False'
field: 'F{{' (yield | starlist) 'F}}'
inlist: inner ( compfor | (',' [inner])* )
trailer: '(' [arglist] ')' | '[' subscript (',' [subscript])* ']' | '.' NAME
subscript: '*' expr | named [':' [test] [':' [test]]] | ':' [test] [':' [test]]
dictorset: '**' expr [dicttail] | '*' expr [settail] | named ( ':' test [compfor | dicttail] | [compfor | settail] )
dicttail: (',' ['**' expr | test ':' test])+
settail: (',' ['*' expr | named])+
arglist: '*' test [',' [arglist]] | '**' test [',' [afterdict]] | test ( '=' test [',' [keywords]] | [compfor | ':=' test] [',' [arglist]] )
keywords: '*' test [',' [keywords]] | '**' test [',' [afterdict]] | test '=' test [',' [keywords]]
afterdict: '**' test [',' [afterdict]] | test '=' test [',' [afterdict]]
compfor: ['async'] 'for' targets 'in' ortest [compiter]
compiter: compfor | 'if' comptest [compiter]
comptest: ortest [':=' test] | lambda
"""

JSON = """
file: value EOF
value: STR | NUM | 'true' | 'false' | 'null' | '{' [STR ':' value (',' STR ':' value)*] '}' | '[' [value (',' value)*] ']'
"""

XML = """
file: [DECL] misc* [DOCTYPE misc*] element misc* EOF
misc: SPACE | COMMENT | PI
element: EMPTY | OPEN content* CLOSE
content: element | TEXT | SPACE | COMMENT | PI | CDATA | REF
"""
