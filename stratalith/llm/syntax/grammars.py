"""Grammars of the checked languages, written as rules for ``derivatives.Grammar``.

Expressions are flat where precedence cannot change what is valid. Semicolons that a language
lets the writer omit are inserted by its lexer (Go) or by the driver loop in ``check``
(ECMAScript), never by the rules.
"""

from __future__ import annotations

from functools import cache

from stratalith.llm.syntax.derivatives import Grammar

PYTHON = r"""
file = (NEWLINE | stmt)*
stmt = simple | compound
simple = small (';' small)* ';'? NEWLINE
small = exprstmt | 'pass' | 'break' | 'continue' | 'del' target % ',' ','? | 'return' exprs? | 'raise' (test ('from' test)?)?
    | 'global' nm % ',' | 'nonlocal' nm % ',' | 'import' dotted ('as' nm)? (',' dotted ('as' nm)?)* | fromimp | 'assert' test (',' test)? | 'type' nm tparams? '=' test
fromimp = 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | imp % ',' | '(' imp % ',' ','? ')')
imp = nm ('as' nm)?
dotted = nm ('.' nm)*
nm = NAME | 'match' | 'case' | 'type'
exprstmt = value | (targets '=')+ value | single augop value | single ':' test ('=' value)?
value = exprs | yieldx
augop = '+=' | '-=' | '*=' | '@=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' | '//='
targets = startarget (',' startarget)* ','?
startarget = '*'? target
target = single | '(' (startarget (',' startarget)* ','?)? ')' | '[' (startarget (',' startarget)* ','?)? ']'
single = nm | 'await'? atom trailer* access | '(' single ')'
access = '.' nm | '[' slices ']'
trailer = access | '(' args ')'
exprs = sexpr (',' sexpr)* ','?
sexpr = '*' bitor | test
gexpr = '*' bitor | named
named = test | nm ':=' test
test = ortest ('if' ortest 'else' test)? | lambda
lambda = 'lambda' lparams ':' test
lparams = (lparam % ',' ','?)?
lparam = nm ('=' test)? | '*' nm? | '**' nm | '/'
ortest = nottest (('and' | 'or') nottest)*
nottest = 'not'* comparison
comparison = bitor (compop bitor)*
compop = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?
bitor = factor (arop factor)*
arop = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '<<' | '>>' | '&' | '|' | '^'
factor = ('-' | '+' | '~')* power
power = 'await'? atom trailer* ('**' factor)?
atom = nm | NUM | (STR | fstr)+ | 'None' | 'True' | 'False' | '...' | '(' (yieldx | gexpr (compfor | (',' gexpr)* ','?))? ')' | '[' (gexpr (compfor | (',' gexpr)* ','?))? ']' | '{' dictset? '}'
fstr = FSTART ffield* FEND
ffield = 'F{' value 'F='? 'F!'? ('F:' ffield*)? 'F}'
dictset = gexpr (compfor | (',' gexpr)* ','?) | ditem (compfor | (',' ditem)* ','?)
ditem = test ':' test | '**' bitor
compfor = ('async'? 'for' targets 'in' ortest ('if' (ortest | nm ':=' test))*)+
yieldx = 'yield' (exprs | 'from' test)?
args = (arg (',' arg)* ','?)?
arg = named compfor? | nm '=' test | '*' test | '**' test
slices = slice (',' slice)* ','?
slice = named | '*' bitor | test? ':' test? (':' test?)?
compound = if | while | for | try | with | def | class | 'async' (def | for | with) | ('@' named NEWLINE)+ ('async'? def | class) | match
suite = simple | NEWLINE INDENT stmt+ DEDENT
if = 'if' named ':' suite ('elif' named ':' suite)* else?
else = 'else' ':' suite
while = 'while' named ':' suite else?
for = 'for' targets 'in' exprs ':' suite else?
try = 'try' ':' suite (except+ else? finally? | finally)
except = 'except' '*'? (test ('as' nm)?)? ':' suite
finally = 'finally' ':' suite
with = 'with' (witem % ',' | '(' witem % ',' ','? ')') ':' suite
witem = test ('as' startarget)?
def = 'def' nm tparams? '(' params ')' ('->' test)? ':' suite
params = (param % ',' ','?)?
param = nm (':' test)? ('=' test)? | '*' (nm (':' ('*' bitor | test))?)? | '**' nm (':' test)? | '/'
tparams = '[' tparam % ',' ','? ']'
tparam = ('*' | '**')? nm (':' test)? ('=' test)?
class = 'class' nm tparams? ('(' args ')')? ':' suite
match = 'match' exprs ':' NEWLINE INDENT casex+ DEDENT
casex = 'case' pattern (',' pattern)* ','? ('if' named)? ':' suite
pattern = '*' nm | aspat
aspat = closedpat ('|' closedpat)* ('as' nm)?
closedpat = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | nm ('.' nm)* ('(' (patarg % ',' ','?)? ')')? | '(' (pattern % ',' ','?)? ')' | '[' (pattern % ',' ','?)? ']' | '{' (mapat % ',' ','?)? '}'
patarg = (nm '=')? pattern
mapat = '**' nm | ('-'? NUM | STR+ | 'None' | 'True' | 'False' | nm ('.' nm)+) ':' pattern
"""

ECMA = r"""
file = item*
item = stmt | import | export | tsdecl
stmt = block | 'var' vdecl % ',' ';' | 'let' vdecl % ',' ';' | 'const' cdecl % ',' ';' | ';' | !('{' 'function' 'class') expr ';' | function | decorator* class
    | 'if' '(' expr ')' stmt ('else' stmt)? | for | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'? | 'return' expr? ';' | ('break' | 'continue') nm? ';'
    | 'throw' expr ';' | 'try' block ('catch' ('(' bind tann ')')? block ('finally' block)? | 'finally' block) | switch | nm ':' stmt | 'debugger' ';'
block = '{' inner* '}'
inner = stmt | innerdecl
for = 'for' 'await'? '(' ((('var' | 'let') vdecl % ',' | 'const' cdecl % ',' | !('let') expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') bind | lhs) ('of' assign | 'in' expr)) ')' stmt
switch = 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' inner*)* '}'
vdecl = nm bang? tann ('=' assign)? | bindpat tann '=' assign
cdecl = bind tann '=' assign
bind = nm | bindpat
bindpat = '[' (','* bindel (','+ bindel)*)? ','* ']' | '{' (bindprop % ',' ','?)? '}'
bindel = bind ('=' assign)? | '...' bind
bindprop = nm ('=' assign)? | propname ':' bind ('=' assign)? | '...' bind
expr = assign (',' assign)*
assign = arrow | yieldx | casts lhs tail | prefix+ casts lhs ('++' | '--')? post binary
tail = assignop assign | ('++' | '--')? post binary
binary = (binop (prefix* casts lhs ('++' | '--')? post | PRIV))* ('?' assign ':' assign)?
prefix = 'delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | '++' | '--' | 'await'
binop = '**' | '*' | '/' | '%' | '+' | '-' | '<<' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&' | '^' | '|' | '&&' | '||' | '??' | 'in' | 'instanceof' | shift
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | shiftassign
yieldx = 'yield' ('*'? assign)?
arrow = 'async'? (nm '=>' abody | tparams '(' params ')' tret '=>' abody)
abody = block | !('{') assign
lhs = 'new'* primary suffix*
suffix = '.' anyname | '.' PRIV | '?.' (anyname | PRIV | '[' expr ']' | '(' args ')') | '[' expr ']' | '(' args ')' | template | bang | targs1 ('(' args ')' | template)
args = ('...'? assign) %? ','
primary = 'this' | 'super' | nm | NUM | STR | 'true' | 'false' | 'null' | REGEX | template | '(' expr ')' | array | object | function | decorator* class | 'import' ('(' args ')' | '.' 'meta') | 'new' '.' 'target' | PRIV 'in' lhs
template = TPL | TPLHEAD expr (TPLMID expr)* TPLTAIL
array = '[' (','* elem (','+ elem)*)? ','* ']'
elem = '...'? assign
object = '{' prop %? ',' '}'
prop = '...' assign | propname ':' assign | nm ('=' assign)? | method
method = ('async'? '*'? | 'get' | 'set') propname tparams '(' params ')' tret block
propname = anyname | STR | NUM | PRIV | '[' assign ']'
function = 'async'? 'function' '*'? nm? tparams '(' params ')' tret (block | nobody)
params = param %? ','
param = decorator* access* (bind | thisparam) optional tann ('=' assign)? | '...' bind tann
class = classmod 'class' nm? tparams ('extends' lhs targs)? implements '{' member* '}'
member = ';' | decorator* cmod* (('async'? '*'? | 'get' | 'set') propname optional tparams '(' params ')' tret (block | nobody ';') | propname optional bang? tann ('=' assign)? ';') | 'static' block | indexsig
cmod = 'static' | tscmod
decorator = '@' lhs
import = 'import' (STR | impclause 'from' STR) (('with' | 'assert') object)? ';'
impclause = nm (',' (ns | named))? | ns | named | tsimp
ns = '*' 'as' nm
named = '{' (spec %? ',') '}'
spec = tstype (anyname | STR) ('as' (anyname | STR))?
export = 'export' ('default' (function | decorator* class | !('function' 'class') assign ';' | tsdefault) | decl | named ('from' STR)? ';' | '*' ('as' (anyname | STR))? 'from' STR ';' | tsexport)
decl = 'var' vdecl % ',' ';' | 'let' vdecl % ',' ';' | 'const' cdecl % ',' ';' | function | decorator* class | exportable
nm = NAME | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'target' | 'meta' | tsword
anyname = nm | 'await' | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' | 'implements' | 'interface' | 'let' | 'package' | 'private' | 'protected' | 'public' | 'static' | 'yield'
shift@js = '>>' | '>>>'
shift@ts = '>' '>' '>'?
shiftassign@js = '>>=' | '>>>='
shiftassign@ts = '>' '>'? '>='
none =
tsdecl@js = NEVER
innerdecl@js = NEVER
nobody@js = NEVER
tann@js = none
tret@js = none
tparams@js = none
targs@js = none
targs1@js = NEVER
casts@js = none
post@js = none
bang@js = NEVER
optional@js = none
access@js = NEVER
thisparam@js = NEVER
implements@js = none
classmod@js = none
tscmod@js = NEVER
indexsig@js = NEVER
tsimp@js = NEVER
tstype@js = none
tsdefault@js = NEVER
tsexport@js = NEVER
exportable@js = NEVER
tsword@js = NEVER
tsword@ts = 'type' | 'declare' | 'namespace' | 'module' | 'abstract' | 'readonly' | 'is' | 'keyof' | 'infer' | 'asserts' | 'satisfies' | 'override' | 'unique' | 'global' | 'accessor' | 'out'
tann@ts = (':' type)?
tret@ts = (':' type)?
optional@ts = ('?' | '!')?
bang@ts = '!'
casts@ts = ('<' type '>')*
post@ts = (('as' | 'satisfies') type)*
access@ts = 'public' | 'private' | 'protected' | 'readonly' | 'override'
thisparam@ts = 'this'
implements@ts = ('implements' type % ',')?
classmod@ts = 'abstract'?
tscmod@ts = 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'accessor'
indexsig@ts = cmod* '[' nm ':' type ']' ':' type ';'
tsimp@ts = 'type' (nm | ns | named)
tstype@ts = 'type'?
nobody@ts = none
tsdefault@ts = interface | 'abstract' class
tsexport@ts = 'type' (named ('from' STR)? | '*' ('as' anyname)? 'from' STR) ';' | '=' expr ';' | 'as' 'namespace' nm ';'
exportable@ts = typedecl | 'declare' (typedecl | ('namespace' | 'module') (nm ('.' nm)* | STR) '{' (item | ambient)* '}' | 'module' STR ';' | 'const' (nm ':' type) % ',' ';' | 'var' vdecl % ',' ';' | 'let' vdecl % ',' ';' | 'const' vdecl % ',' ';' | function | class) | 'import' nm '=' lhs ';'
typedecl@ts = interface | 'type' nm tparams '=' type ';' | 'const'? 'enum' nm '{' enumel %? ',' '}' | ('namespace' | 'module') (nm ('.' nm)* | STR) '{' item* '}' | 'global' '{' (item | ambient)* '}'
ambient@ts = 'export'? 'const' (nm ':' type) % ',' ';'
innerdecl@ts = typedecl
tsdecl@ts = exportable
enumel@ts = propname ('=' assign)?
interface@ts = 'interface' nm tparams ('extends' type % ',')? objtype
tparams@ts = ('<' tparam % ',' ','? '>')?
tparam@ts = ('const' | 'in' | 'out')* nm ('extends' type)? ('=' type)?
targs@ts = targs1?
targs1@ts = '<' type % ',' '>'
type@ts = 'asserts'? (nm | 'this') 'is' type | 'asserts' nm | fntype | union ('extends' union '?' type ':' type)?
fntype@ts = 'abstract'? 'new'? tparams '(' params ')' '=>' type
union@ts = '|'? inter ('|' (inter | fntype))*
inter@ts = '&'? tpost ('&' tpost)*
tpost@ts = ('keyof' | 'unique' | 'readonly' | 'infer')* tprim ('[' type? ']')* ('extends' tpost)?
tprim@ts = '(' type ')' | nm ('.' anyname)* targs | 'this' | 'void' | 'null' | STR | '-'? NUM | 'true' | 'false' | ttemplate | '[' tuplel %? ',' ']' | objtype | 'typeof' ('import' '(' args ')' | nm) ('.' (anyname | PRIV))* targs | 'import' '(' args ')' ('.' anyname)* targs
ttemplate@ts = TPL | TPLHEAD type (TPLMID type)* TPLTAIL
tuplel@ts = '...'? (nm '?'? ':')? type '?'?
objtype@ts = '{' (tmember (';' | ','))* tmember? '}'
tmember@ts = ('readonly' | '+' | '-')* ('get' | 'set')? propname '?'? ((':' type)? | tparams '(' params ')' tret) | 'new'? tparams '(' params ')' tret | ('readonly' | '+' | '-')* '[' nm (':' type | 'in' type ('as' type)?) ']' (('+' | '-')? '?')? (':' type)?
"""

RUST = r"""
file = inattr* item*
inattr = '#' '!' '[' tt* ']'
attr = '#' '[' tt* ']'
tt = ~('(' ')' '[' ']' '{' '}') | '(' tt* ')' | '[' tt* ']' | '{' tt* '}'
item = attr* (vis? kind | macroitem)
vis = 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')?
kind = fn | struct | enum | trait | impl | 'mod' nm (';' | '{' inattr* item* '}') | 'use' usetree ';' | 'const' (nm | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? nm ':' type ('=' expr)? ';'
    | 'type' nm generics? (':' bounds)? where? ('=' type where?)? ';' | 'unsafe'? 'extern' STR? '{' inattr* item* '}' | 'extern' 'crate' (nm | 'self') ('as' (nm | '_'))? ';' | 'union' nm generics? where? '{' field %? ',' '}'
macroitem = mpath '!' nm? ('{' tt* '}' | '(' tt* ')' ';' | '[' tt* ']' ';')
mpath = '::'? (nm | 'crate' | 'self' | 'super' | 'macro_rules') ('::' nm)*
nm = NAME | 'union' | 'default' | 'raw' | 'macro_rules'
fn = ('const' | 'async' | 'unsafe' | 'default' | 'extern' STR?)* 'fn' nm generics? '(' fparam %? ',' ')' ret? where? (block | ';')
ret = '->' type
fparam = attr* (('&' LIFE?)? 'mut'? 'self' (':' type)? | pat1 ':' type | '...')
generics = '<' gparam %? ',' '>'
gparam = attr* (LIFE (':' bounds?)? | nm (':' bounds?)? ('=' type)? | 'const' nm ':' type ('=' (block | '-'? literal | nm))?)
where = 'where' (forlt? (LIFE | type) ':' bounds?) %? ','
forlt = 'for' '<' gparam %? ',' '>'
bounds = bound ('+' bound)* '+'?
bound = LIFE | ('?' | '~' 'const')? forlt? tpath | '(' bound ')'
struct = 'struct' nm generics? (where? '{' field %? ',' '}' | '(' tfield %? ',' ')' where? ';' | where? ';')
field = attr* vis? nm ':' type
tfield = attr* vis? type
enum = 'enum' nm generics? where? '{' variant %? ',' '}'
variant = attr* vis? nm ('(' tfield %? ',' ')' | '{' field %? ',' '}')? ('=' expr)?
trait = 'unsafe'? 'trait' nm generics? (':' bounds?)? where? '{' inattr* item* '}'
impl = 'default'? 'unsafe'? 'impl' generics? 'const'? ('!'? type 'for')? type where? '{' inattr* item* '}'
usetree = '::'? (useseg '::')* (useseg ('as' (nm | '_'))? | '*' | '{' usetree %? ',' '}')
useseg = nm | 'crate' | 'self' | 'super'
type = ('&' | '&&') LIFE? 'mut'? type1 | type1 | 'impl' bounds | 'dyn' bounds
type1 = ('&' | '&&') LIFE? 'mut'? type1 | '*' ('const' | 'mut') type1 | '[' type (';' expr)? ']' | '(' type %? ',' ')' | '!' | '_' | tpath macroargs? | '<' type ('as' tpath)? '>' ('::' tseg)+ | forlt? ('unsafe' | 'extern' STR?)* 'fn' '(' (attr* ((nm | '_') ':')? type | '...') %? ',' ')' ret? | 'dyn' bound | 'impl' bound | forlt tpath
macroargs = '!' ('(' tt* ')' | '[' tt* ']' | '{' tt* '}')
tpath = '::'? tseg ('::' tseg)*
tseg = (nm | 'Self' | 'self' | 'super' | 'crate') ('::'? '<' garg %? ',' '>' | '(' type %? ',' ')' ret?)?
garg = LIFE | type | nm ('<' garg %? ',' '>')? ('=' type | ':' bounds) | '-'? literal | block
path = '::'? pseg ('::' pseg)*
pseg = nm | 'Self' | 'self' | 'super' | 'crate' | '<' garg %? ',' '>' | '<' type 'as' tpath '>'
literal = NUM | STR | 'true' | 'false'
block = '{' inattr* body '}'
body = none | ';' body | item body | attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' body | attr* blocklike (';'? body | dotted (';' body)?) | attr* expr0 (';' body)?
none =
dotted = ('?' | '.' member) post* (binop unary | '..' unary? | '..=' unary)*
blocklike = 'unsafe'? block | 'async' 'move'? block | 'const' block | (LIFE ':')? (loop | block) | if | match | mpath '!' '{' tt* '}'
loop = 'loop' block | 'while' cond block | 'for' pat 'in' exprn block
if = 'if' cond block ('else' (if | block))?
cond = condpart ('&&' condpart)*
condpart = exprn | 'let' pat '=' exprn
match = 'match' exprn '{' inattr* arms '}'
arms = none | attr* pat ('if' cond)? '=>' (blocklike (','? arms | dotted (',' arms)?) | expr0 (',' arms)?)
expr0 = range | unary0 (binop unary | '..' unary? | '..=' unary)*
unary0 = prefix+ (prim post* | closure | jump) | prim0 post* | closure | jump
expr = range | unary (binop unary | '..' unary? | '..=' unary)*
exprn = rangen | unaryn (binop unaryn | '..' unaryn? | '..=' unaryn)*
range = '..' unary? (binop unary)* | '..=' unary (binop unary)*
rangen = '..' unaryn? (binop unaryn)* | '..=' unaryn (binop unaryn)*
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>=' | '>' | '<' | '>=' | '<=' | '==' | '!=' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<='
prefix = '-' | '!' | '*' | ('&' | '&&') ('raw' ('const' | 'mut') | 'mut')?
unary = prefix* (prim post* | closure | jump)
unaryn = prefix* (primn post* | closure | jumpn)
post = '?' | '.' member | '(' args ')' | '[' expr ']' | 'as' type1
args = (attr* expr) %? ','
member = nm ('::' '<' garg %? ',' '>')? ('(' args ')')? | NUM | 'await'
jump = 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE?
jumpn = 'return' exprn? | 'break' LIFE? exprn? | 'continue' LIFE?
closure = forlt? ('static' | 'async' | 'move')* ('|' (attr* pat1 (':' type)?) %? ',' '|' | '||') (expr | ret block)
primn = plain | path '!' '{' tt* '}' | blocklike
plain = literal | path ('!' ('(' tt* ')' | '[' tt* ']'))? | 'macro_rules' '!' tt | '(' args ')' | '[' (args | expr ';' expr) ']' | '_'
prim0 = plain | path '{' structlit '}'
prim = primn | path '{' structlit '}'
structlit = ((attr* (nm | NUM) (':' expr)?) % ',' (',' ('..' expr?)?)?)? | '..' expr?
pat = '|'? pat1 ('|' pat1)*
pat1 = patlit (('..' | '..=' | '...') patlit?)? | '..=' patlit | '..' patlit? | '_' | ('&' | '&&') 'mut'? pat1 | 'ref'? 'mut'? nm ('@' pat1)? | '(' pat %? ',' ')' | '[' pat %? ',' ']' | path ('(' pat %? ',' ')' | '{' fieldpat %? ',' '}' | macroargs) | 'box' pat1
patlit = '-'? literal | path
fieldpat = attr* ((nm | NUM) ':' pat | 'box'? 'ref'? 'mut'? nm | '..')
"""

GO = r"""
file = 'package' NAME ';' ('import' (impspec | '(' (impspec ';')* impspec? ')') ';')* (top ';')*
impspec = ('.' | NAME)? STR
top = 'func' (('(' params ')')? NAME tparams? sig block?) | decl
decl = 'const' (cspec | '(' (cspec ';')* cspec? ')') | 'var' (vspec | '(' (vspec ';')* vspec? ')') | 'type' (tspec | '(' (tspec ';')* tspec? ')')
cspec = NAME % ',' (type? '=' expr % ',')?
vspec = NAME % ',' (type ('=' expr % ',')? | '=' expr % ',')
tspec = NAME tparams? '='? type
tparams = '[' (NAME % ',' cons) %? ',' ']'
cons = tterm ('|' tterm)*
tterm = '~'? type
sig = '(' params ')' result?
result = '(' params ')' | type
params = (NAME? '...'? type | NAME) %? ','
type = ptype | '(' type ')'
ptype = tname | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | struct | interface
tname = NAME ('.' NAME)? ('[' type % ',' ','? ']')?
struct = 'struct' '{' (fieldd ';')* fieldd? '}'
fieldd = (NAME % ',' type | '*'? tname) STR?
interface = 'interface' '{' (ielem ';')* ielem? '}'
ielem = NAME sig | cons
block = '{' stmts '}'
stmts = (stmt? ';')* stmt?
stmt = simple | decl | 'return' (expr % ',')? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | 'defer' expr | 'go' expr | block | if | for | switch | select | NAME ':' stmt?
simple = expr ('++' | '--' | '<-' expr | asg expr % ',' | (',' expr)* ('=' | ':=') expr % ',')?
simplen = exprn ('++' | '--' | '<-' exprn | asg exprn % ',' | (',' exprn)* ('=' | ':=') exprn % ',')?
asg = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
if = 'if' (simplen? ';')? exprn block ('else' (if | block))?
for = 'for' (exprn | simplen? ';' exprn? ';' simplen? | ((exprn % ',') ('=' | ':='))? 'range' exprn)? block
switch = 'switch' (simplen? ';')? (simplen)? '{' (('case' (expr | type) % ',' | 'default') ':' stmts)* '}'
select = 'select' '{' (('case' simple | 'default') ':' stmts)* '}'
expr = unary (binop unary)*
exprn = unaryn (binop unaryn)*
binop = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
prefix = '+' | '-' | '!' | '^' | '*' | '&' | '<-'
unary = prefix* prim post*
unaryn = prefix* primn post*
post = '.' (NAME | '(' (type | 'type') ')') | '[' (expr | ptype) (',' type)* ','? ']' | '[' expr? ':' expr? (':' expr)? ']' | '(' args ')'
args = ((expr | ptype) '...'?) %? ','
primn = NAME | NUM | STR | '(' (expr | ptype) ')' | 'func' sig block? | ('[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | struct) lit? | 'chan' type | interface
prim = primn | tname lit
lit = '{' (elem (',' elem)* ','?)? '}'
elem = ((expr | lit) ':')? (expr | lit)
"""

JAVA = r"""
file = (anno* 'package' qname ';')? (';' | 'import' 'static'? qname ('.' '*')? ';')* (';' | typedecl)* | moduledecl
moduledecl = ('import' qname ('.' '*')? ';')* anno* 'open'? 'module' qname '{' (~('{' '}'))* '}'
qname = id ('.' id)*
id = NAME | 'var' | 'record' | 'sealed' | 'permits' | 'non' | 'yield' | 'module' | 'open' | 'requires' | 'exports' | 'opens' | 'uses' | 'provides' | 'to' | 'with' | 'transitive'
anno = '@' qname ('(' (elval | (id '=' elval) %? ',')? ')')?
elval = cond | anno | '{' elval %? ',' '}'
mods = (anno | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed')*
typedecl = mods (class | interface | enum | record | annotype)
class = 'class' id tparams? ('extends' type)? ('implements' type % ',')? ('permits' type % ',')? cbody
interface = 'interface' id tparams? ('extends' type % ',')? ('permits' type % ',')? cbody
annotype = '@' 'interface' id cbody
enum = 'enum' id ('implements' type % ',')? '{' (econst %? ',') (';' member*)? '}'
econst = anno* id ('(' args ')')? cbody?
record = 'record' id tparams? '(' (mods type '...'? id) %? ',' ')' ('implements' type % ',')? cbody
tparams = '<' (anno* id ('extends' type ('&' type)*)?) % ',' '>'
cbody = '{' member* '}'
member = ';' | 'static'? block | mods (class | interface | enum | record | annotype | tparams? (type | 'void') id '(' params ')' dims throws? ('default' elval)? (block | ';') | tparams? id '(' params ')' throws? block | id block | type vdecl % ',' ';')
throws = 'throws' type % ','
params = (param (',' param)*)?
param = mods type '...'? (id dims | (id '.')? 'this')
dims = ('[' ']')*
vdecl = id dims ('=' (cond | assign | arrinit))?
arrinit = '{' (cond | assign | arrinit) %? ',' '}'
type = anno* (prim | ctype) (anno* '[' ']')*
prim = 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' | 'boolean'
ctype = id targs? ('.' anno* id targs?)*
targs = '<' (targ % ',')? '>'
targ = type | anno* '?' (('extends' | 'super') type)?
block = '{' stmt* '}'
stmt = ';' | block | localdecl ';' | mods (class | interface | enum | record) | stmtexpr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | for | 'return' expr? ';' | 'break' id? ';' | 'continue' id? ';' | 'throw' expr ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';' | 'synchronized' '(' expr ')' block | try | switch ';'? | id ':' stmt
localdecl = (anno | 'final')* type vdecl % ','
for = 'for' '(' ((localdecl | stmtexpr % ',')? ';' expr? ';' (stmtexpr % ',')? | (anno | 'final')* type id ':' expr) ')' stmt
try = 'try' ('(' (resource (';' resource)* ';'?) ')' block catch* finally? | block (catch+ finally? | finally))
resource = localdecl | expr
catch = 'catch' '(' (anno | 'final')* type ('|' type)* id ')' block
finally = 'finally' block
switch = 'switch' '(' expr ')' '{' (label stmt*)* '}' | 'switch' '(' expr ')' '{' (('case' clabel % ',' | 'default') '->' (expr ';' | block | 'throw' expr ';'))* '}'
label = ('case' clabel % ',' | 'default') ':'
clabel = cond | 'default' | (anno | 'final')* type id ('&&' cond)?
stmtexpr = ('++' | '--') unary | primary (post* call | post* (('++' | '--') | assignop expr) | post*) | 'new' creator post* (assignop expr)?
call = '(' args ')'
expr = cond | assign
assign = primary post* assignop expr
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '&=' | '|=' | '^=' | '%=' | '<<=' | '>' '>=' | '>' '>' '>='
cond = lambda | bin ('?' expr ':' (cond | lambda))?
bin = unary (binop unary | 'instanceof' 'final'? type id?)*
binop = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%'
unary = ('+' | '-' | '++' | '--' | '~' | '!')* (primary post* ('++' | '--')* | cast)
cast = '(' type ('&' type)* ')' (unary | lambda)
lambda = (id | '(' (param %? ',' | id %? ',') ')') '->' (expr | block)
primary = NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | id | '(' expr ')' | 'new' creator | (prim | 'void') dims '.' 'class' | prim dims '::' 'new' | ctype ('[' ']')* ('::' targs? (id | 'new')) | ctype ('[' ']')+ '.' 'class' | switch
creator = anno* (prim | ctype) (anno* '[' expr ']')* (anno* '[' ']')* ('(' args ')' cbody? | arrinit)?
post = '.' (targs? (id | 'super') | 'this' | 'class' | 'new' anno* ctype '(' args ')' cbody?) | '[' expr ']' | '(' args ')' | '::' targs? (id | 'new')
args = expr %? ','
"""

C = r"""
file = ext*
ext = ';' | specs (initdecl % ',')? ';' | specs declarator attrs (decl)* block | '_Static_assert' '(' expr (',' STR+)? ')' ';' | ('asm' | '__asm__') '(' STR+ ')' ';'
attrs = ('__attribute__' '(' '(' tt* ')' ')' | ('asm' | '__asm__') '(' STR+ ')')*
tt = ~('(' ')') | '(' tt* ')'
pre = 'typedef' | 'extern' | 'static' | 'auto' | 'register' | 'inline' | '__inline' | '_Noreturn' | '_Thread_local' | '__extension__' | qual | '_Alignas' '(' (typename | expr) ')' | '__attribute__' '(' '(' tt* ')' ')'
qual = 'const' | 'restrict' | '__restrict' | 'volatile' | '_Atomic'
word = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex'
specs = pre* (NAME | word (word | pre)* | sue | '_Atomic' '(' typename ')') pre*
sue = ('struct' | 'union') attrs (NAME | NAME? '{' member* '}') | 'enum' attrs (NAME | NAME? '{' enumel %? ',' '}')
member = ';' | specs (mdecl % ',')? ';' | '_Static_assert' '(' expr (',' STR+)? ')' ';'
mdecl = declarator attrs (':' cond)? | ':' cond
enumel = NAME ('=' cond)?
decl = specs (initdecl % ',')? ';' | '_Static_assert' '(' expr (',' STR+)? ')' ';'
initdecl = declarator attrs ('=' init)?
init = assign | '{' (desig? init) %? ',' '}'
desig = ('[' cond ('...' cond)? ']' | '.' NAME)+ '=' | NAME ':'
ptr = ('*' qual*)*
declarator = ptr attrs (NAME | '(' declarator ')') dsuf*
dsuf = '[' ('static' | qual)* (assign | '*')? ']' | '(' params? ')'
params = param (',' param)* (',' '...')?
param = specs (declarator | absdecl) attrs
absdecl = ptr ('(' absdecl ')')? dsuf*
typename = tspecs absdecl
tspecs = qual* (NAME | word (word | qual)* | sue) qual*
block = '{' (decl | stmt)* '}'
stmt = block | expr? ';' | NAME ':' attrs (stmt | decl | none) | 'case' cond ('...' cond)? ':' (stmt | decl | none) | 'default' ':' (stmt | decl | none) | 'if' '(' expr ')' stmt ('else' stmt)? | 'switch' '(' expr ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (decl | expr? ';') expr? ';' expr? ')' stmt | 'goto' NAME ';' | 'continue' ';' | 'break' ';' | 'return' expr? ';' | ('asm' | '__asm__') ('volatile' | 'goto')* '(' tt* ')' ';'
none =
expr = assign (',' assign)*
assign = unary (asgop assign | (binop unary)* ('?' expr? ':' cond)?)
cond = unary (binop unary)* ('?' expr? ':' cond)?
asgop = '=' | '*=' | '/=' | '%=' | '+=' | '-=' | '<<=' | '>>=' | '&=' | '^=' | '|='
binop = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%'
unary = ('++' | '--' | '&' | '*' | '+' | '-' | '~' | '!' | '__extension__' | 'sizeof' | '(' typename ')')* (prim post* | ('sizeof' | '_Alignof') '(' typename ')')
prim = NAME | NUM | CHR | (NAME? STR)+ NAME? | '(' expr ')' | '(' block ')' | '(' typename ')' '{' (desig? init) %? ',' '}' | '_Generic' '(' assign (',' (typename | 'default') ':' assign)+ ')'
argtype = tspecs ptr ('(' '*' qual* ptr ')' dsuf*)? ('[' cond? ']')*
post = '[' expr ']' | '(' ((assign | argtype) % ',')? ')' | '.' NAME | '->' NAME | '++' | '--'
"""

JSON = r"""
file = value
value = STR | NUM | 'true' | 'false' | 'null' | '[' (value (',' value)*)? ']' | '{' (pair (',' pair)*)? '}'
pair = STR ':' value
"""

# Languages by file extension.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "json": "json",
}

_TEXT = {"python": PYTHON, "javascript": ECMA, "typescript": ECMA, "rust": RUST, "go": GO, "java": JAVA, "c": C, "json": JSON}
_FLAGS = {"javascript": frozenset(["js"]), "typescript": frozenset(["ts"])}


@cache
def grammar(lang: str) -> Grammar:
    return Grammar(_TEXT[lang], "file", _FLAGS.get(lang, frozenset()))
