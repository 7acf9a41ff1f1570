"""Grammars of four language families over texts whose brackets are folded.

A bracketed group is one symbol of the text around it and a text of its own; the
grammar names it by what it must be: ``@block`` is a group that can be read as a
block.  Acceptance is all that counts, so binary operators have no precedence.

Notation: ``name = alternatives``; "x" is the token x, capitals are classes of
tokens, ``?`` ``*`` ``+`` and parentheses as usual.  Lines that begin with ``ts:``
hold for TypeScript only.  ``ASI`` is a line break or the end of a group, where
JavaScript supplies a semicolon.
"""

JAVASCRIPT = r"""
program = top*
top = import | export | stmt
import = "import" (STR | clause "from" STR) attributes? end
attributes = ("with" | "assert") @object
clause = name ("," (@names | "*" "as" name))? | @names | "*" "as" name
export = "export" ("*" ("as" word)? "from" STR end | @names ("from" STR)? end | "default" (function | class | expr end) | decl)
decl = function | class | variable end
ts: import = "import" "type" clause "from" STR end | "import" name "=" expr end
ts: export = "export" "type" @names ("from" STR)? end | "export" "=" expr end | "export" "as" "namespace" name end
ts: decl = interface | alias | enum | namespace | "declare" (decl | namespace | function) | "abstract" class | overload
ts: overload = "async"? "function" name typeparams? @params (":" type)? end
ts: interface = "interface" name typeparams? ("extends" typeref ("," typeref)*)? @members
ts: alias = "type" name typeparams? "=" type end
ts: enum = "const"? "enum" name @enum
ts: namespace = ("namespace" | "module") (name ("." name)* | STR) @block
names_whole = (nameitem ("," nameitem)* ","?)?
nameitem = word ("as" word)? | STR "as" word
ts: nameitem = "type" word ("as" word)?
stmts = stmt*
stmt = @block | ";" | decl | expr end | "if" @paren stmt ("else" stmt)? | "while" @paren stmt | "do" stmt "while" @paren ";"? | "for" "await"? @for stmt
stmt = "return" expr? end | "break" name? end | "continue" name? end | "throw" expr end | "switch" @paren @switch | "debugger" end | name ":" stmt
stmt = "try" @block (catch finally? | finally)
catch = "catch" @catch? @block
finally = "finally" @block
end = ";" | ASI
variable = ("const" | "let" | "var") binding ("," binding)*
binding = target ("=" assign)?
ts: binding = target "!"? ":" type ("=" assign)?
target = name | @objpat | @arrpat
function = "async"? "function" "*"? name? typeparams? @params result? @block
result = NEVER
typeparams = NEVER
ts: result = ":" type | ":" "asserts"? name "is" type
ts: typeparams = "<" typeparam ("," typeparam)* ","? ">"
ts: typeparam = ("in" | "out" | "const")* name ("extends" type)? ("=" type)?
class = decorator* "class" name? typeparams? ("extends" postfix)? implements? @class
implements = NEVER
ts: implements = "implements" typeref ("," typeref)*
decorator = "@" name ("." word)* @args?
classbody_whole = member*
member = ";" | decorator* modifier* (method | field) | "static" @block
modifier = "static"
ts: modifier = "public" | "private" | "protected" | "readonly" | "abstract" | "override" | "declare"
method = ("async" | "get" | "set")* "*"? key typeparams? "?"? @params result? (@block | bodyless)
bodyless = NEVER
ts: bodyless = end
field = key ("=" assign)? end
ts: field = key ("?" | "!")? (":" type)? ("=" assign)? end
ts: member = modifier* @index ":" type end
key = word | STR | NUM | "#" word | @computed
params_whole = (param ("," param)* ","?)?
param = decorator* "..."? target ("=" assign)?
ts: param = decorator* modifier* "..."? (target | "this") "?"? (":" type)? ("=" assign)?
catch_whole = target
ts: catch_whole = target ":" type
for_whole = (variable | expr)? ";" expr? ";" expr? | ("const" | "let" | "var")? forleft ("of" assign | "in" expr)
forleft = target | postfix
switch_whole = case*
case = ("case" expr | "default") ":" stmts
expr = assign ("," assign)*
exprs_whole = expr
assign = arrow | chain ("?" assign ":" assign)? | "yield" "*"? assign?
chain = unary (binary (unary | arrow) | cast)*
cast = NEVER
ts: cast = ("as" | "satisfies") type | "as" "const"
binary = "=" | "+=" | "-=" | "*=" | "/=" | "%=" | "**=" | "<<=" | ">" ">=" | ">" ">" ">=" | "&=" | "|=" | "^=" | "&&=" | "||=" | "??="
binary = "+" | "-" | "*" | "/" | "%" | "**" | "<<" | ">" ">" | ">" ">" ">" | "<" | ">" | "<=" | ">=" | "==" | "!=" | "===" | "!==" | "&" | "|" | "^" | "&&" | "||" | "??" | "in" | "instanceof"
arrow = "async"? (name | typeparams? @params result?) "=>" (@block | assign)
unary = prefix* postfix ("++" | "--")?
prefix = "!" | "~" | "+" | "-" | "++" | "--" | "typeof" | "void" | "delete" | "await"
postfix = primary suffix*
suffix = "." word | "." "#" word | "?." word | "?." @args | "?." @index | @args | @index | TPL
ts: suffix = "!" | typeargs @args | typeargs TPL
ts: typeargs = "<" type ("," type)* ">"
primary = name | NUM | STR | TPL | RE | JSX | "this" | "super" | "null" | "true" | "false" | @group | @array | @object | function | class | "import" @args | "import" "." word | new
new = "new" "new"* "." word | "new" newtarget @args?
newtarget = (name | "this" | @group | class | function | new) ("." word | @index)*
ts: newtarget = name ("." word)* typeargs
args_whole = (arg ("," arg)* ","?)?
arg = "..."? assign
index_whole = expr
array_whole = ","* (arg (","+ arg)* ","*)?
object_whole = (property ("," property)* ","?)?
property = "..." assign | name ("=" assign)? | key ":" assign | ("async" | "get" | "set")* "*"? key @params @block
ts: property = ("async" | "get" | "set")* "*"? key typeparams? @params result? @block
objpat_whole = (objitem ("," objitem)* ","?)?
objitem = "..." target | name ("=" assign)? | key ":" target ("=" assign)?
arrpat_whole = ","* (arritem (","+ arritem)* ","*)?
arritem = "..."? target ("=" assign)?
jsx_whole = ("..."? assign)?
template_whole = expr
ts: type = cond | "keyof" type | "readonly" type | "unique" type | typeparams? "new"? @params "=>" type | "asserts"? name "is" type
ts: cond = union ("extends" union "?" type ":" type)?
ts: union = "|"? inter ("|" inter)*
ts: inter = "&"? arraytype ("&" arraytype)*
ts: arraytype = ("keyof" | "typeof" | "readonly" | "infer")* basetype (@emptyindex | @typeindex)*
ts: basetype = typeref | STR | TPL | "-"? NUM | "this" | "null" | "true" | "false" | "void" | "undefined" | @grouptype | @tuple | @members | "import" @args ("." word)*
ts: typeref = name ("." word)* typeargs?
ts: grouptype_whole = type
ts: typeindex_whole = type
ts: tuple_whole = (tupleitem ("," tupleitem)* ","?)?
ts: tupleitem = "..."? (name "?"? ":")? type "?"?
ts: members_whole = (typemember membersep)* typemember?
ts: membersep = ";" | "," | ASI
ts: typemember = ("readonly" | "get" | "set" | "-" | "+")* key "?"? (":" type)? | key "?"? typeparams? @params result? | typeparams? @params result? | "new" @params result? | ("readonly" | "-" | "+")* @mapped ("-"? "?")? ":" type
ts: mapped_whole = name ":" type | name "in" type ("as" type)?
ts: enum_whole = (enumitem ("," enumitem)* ","?)?
ts: enumitem = key ("=" assign)?
name = ID | "async" | "of" | "get" | "set" | "from" | "as" | "static" | "type" | "undefined" | "namespace" | "module" | "declare" | "abstract" | "readonly" | "is" | "infer" | "asserts" | "override" | "satisfies" | "keyof" | "unique" | "target" | "assert" | "out"
name = "public" | "private" | "protected" | "interface" | "implements"
word = ID | KEYWORD
"""
JAVASCRIPT_ROLES = {
    "(": {"paren": "index_whole", "group": "index_whole", "args": "args_whole", "params": "params_whole", "for": "for_whole", "catch": "catch_whole", "grouptype": "grouptype_whole"},
    "[": {"array": "array_whole", "index": "index_whole", "computed": "index_whole", "arrpat": "arrpat_whole", "emptyindex": "EMPTY", "typeindex": "typeindex_whole", "tuple": "tuple_whole", "mapped": "mapped_whole"},
    "{": {"block": "stmts", "object": "object_whole", "class": "classbody_whole", "objpat": "objpat_whole", "names": "names_whole", "switch": "switch_whole", "members": "members_whole", "enum": "enum_whole", "jsx": "jsx_whole", "template": "template_whole"},
}
#: how the items of a group are told apart: by commas or as statements
JAVASCRIPT_ITEMS = {"args": ("arg", ","), "array": ("arg", ","), "object": ("property", ","), "enum": ("enumitem", ","), "block": ("stmts", ";"), "class": ("classbody_whole", ";"), "members": ("members_whole", ";"), "switch": ("switch_whole", "")}
JAVASCRIPT_KEYWORDS = (
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let enum await"
    " async of get set from as static type namespace module declare abstract readonly is infer asserts override satisfies keyof unique public private protected interface implements assert out"
)

RUST = r"""
program = inner* item*
inner = "#" "!" @tree
attr = "#" @tree
item = attr* visibility? (fn | struct | enum | union | trait | impl | mod | use | const | static | alias | externblock | externcrate) | attr* macroitem
visibility = "pub" @vis?
vis_whole = "crate" | "super" | "self" | "in" path
macroitem = path "!" ID? (@tree ";"? )
fn = "const"? "async"? "unsafe"? ("extern" STR?)? "fn" ID generics? @params ("->" type)? where? (@block | ";")
struct = "struct" ID generics? (where? @fields | @tuplefields where? ";" | ";")
union = "union" ID generics? where? @fields
fields_whole = (fielddef ("," fielddef)* ","?)?
fielddef = attr* visibility? ID ":" type
tuplefields_whole = (tupledef ("," tupledef)* ","?)?
tupledef = attr* visibility? type
enum = "enum" ID generics? where? @variants
variants_whole = (variant ("," variant)* ","?)?
variant = attr* ID (@fields | @tuplefields)? ("=" expr)?
trait = "unsafe"? "trait" ID generics? (":" bounds?)? where? @items
impl = "unsafe"? "impl" generics? "!"? type ("for" type)? where? @items
items_whole = inner* associated*
associated = attr* visibility? "default"? (fn | const | alias | "type" ID generics? (":" bounds)? ";") | attr* macroitem
mod = "mod" ID (";" | @mod)
mod_whole = inner* item*
use = "use" usetree ";"
usetree = "::"? (ID | "crate" | "super" | "self" | "Self") ("::" (ID | "self" | "super"))* ("::" ("*" | @uses))? ("as" (ID | "_"))? | "::"? @uses | "*"
uses_whole = (usetree ("," usetree)* ","?)?
const = "const" (ID | "_") ":" type ("=" expr)? ";"
static = "static" "mut"? ID ":" type ("=" expr)? ";"
alias = "type" ID generics? (":" bounds)? where? "=" type ";"
externblock = "unsafe"? "extern" STR? @externs
externs_whole = externitem*
externitem = attr* visibility? (fn | static | "type" ID ";")
externcrate = "extern" "crate" ID ("as" ID)? ";"
generics = "<" (generic ("," generic)* ","?)? ">"
generic = LIFE (":" LIFE ("+" LIFE)*)? | ID (":" bounds?)? ("=" type)? | "const" ID ":" type ("=" literal)?
where = "where" (clause ("," clause)* ","?)?
clause = ("for" generics)? type ":" bounds? | LIFE ":" LIFE ("+" LIFE)*
bounds = bound ("+" bound)* "+"?
bound = LIFE | "?"? ("for" generics)? typepath | @type
type = "&" LIFE? "mut"? type | "&&" LIFE? "mut"? type | "*" ("const" | "mut") type | typepath | "!" | "_" | @tupletype | @arraytype | ("dyn" | "impl") bounds | ("for" generics)? "unsafe"? ("extern" STR?)? "fn" @fntypes ("->" type)? | path "!" @tree | "<" type ("as" typepath)? ">" "::" typepath
type_whole = bound
tupletype_whole = (type ("," type)* ","?)?
arraytype_whole = type (";" expr)?
fntypes_whole = (fntype ("," fntype)* ","?)?
fntype = ((ID | "_") ":")? type
typepath = "::"? typesegment ("::" typesegment)*
typesegment = segment (typeargs | "::" typeargs | @fntypes ("->" type)?)?
typeargs = "<" (typearg ("," typearg)* ","?)? ">"
typearg = LIFE | type | ID "=" type | ID ":" bounds | literal | @block
segment = ID | "self" | "Self" | "super" | "crate"
path = "::"? segment ("::" (segment | typeargs))*
params_whole = (param ("," param)* ","?)?
param = attr* ("&" LIFE?)? "mut"? "self" (":" type)? | attr* pattern ":" type | "..."
block_whole = inner* stmt* expr?
stmts = inner* stmt*
stmt = ";" | item | attr* "let" pattern (":" type)? ("=" expr ("else" @block)?)? ";" | expr ";" | blocklike | macrostmt
macrostmt = path "!" @tree
blocklike = attr* (LIFE ":")? ("unsafe" @block | "async" "move"? @block | @block | if | "match" head @arms | "while" cond @block | "for" pattern "in" head @block | "loop" @block)
if = "if" cond @block ("else" (if | @block))?
cond = ("let" pattern "=")? head ("&&" ("let" pattern "=")? head)*
head = headunary ((binary headunary) | "as" type)*
headunary = prefix* headprimary suffix*
headprimary = literal | exprpath | @parens | @array | "match" head @arms | macrocall | closure | blockhead
blockhead = "unsafe" @block | if
arms_whole = (arm armsep)* arm?
armsep = ","
arms_whole = blockarm* arm? | (arm "," | blockarm)* arm?
arm = attr* "|"? pattern ("|" pattern)* ("if" expr)? "=>" expr
blockarm = attr* "|"? pattern ("|" pattern)* ("if" expr)? "=>" blocklike ","?
pattern = patternitem ("|" patternitem)*
patternitem = "_" | "..=" literal | ".." | "&" "mut"? patternitem | "&&" patternitem | "ref"? "mut"? ID ("@" patternitem)? | "-"? literal (("..=" | ".." | "...") ("-"? literal)?)? | exprpath (@tuplepat | @fieldpat)? | exprpath ("..=" | "..") exprpath | @tuplepat | @slicepat | macrocall
tuplepat_whole = (pattern ("," pattern)* ","?)?
slicepat_whole = (pattern ("," pattern)* ","?)?
fieldpat_whole = (fieldpatitem ("," fieldpatitem)* ","?)?
fieldpatitem = ".." | attr* (ID | NUM) ":" pattern | "ref"? "mut"? ID
literal = NUM | STR | CHAR | "true" | "false"
expr = jump | range | assignment | closure
jump = "return" expr? | "break" LIFE? expr? | "continue" LIFE?
range = operand? (".." | "..=") operand?
assignment = operand (assignop expr)?
assignop = "=" | "+=" | "-=" | "*=" | "/=" | "%=" | "&=" | "|=" | "^=" | "<<=" | ">" ">="
operand = unary ((binary unary) | "as" type)*
binary = "+" | "-" | "*" | "/" | "%" | "&" | "|" | "^" | "<<" | ">" ">" | "&&" | "||" | "==" | "!=" | "<" | ">" | "<=" | ">="
unary = prefix* primary suffix* | closure | prefix* jump
prefix = "-" | "!" | "*" | "&" | "&&" | "&" "mut" | "&&" "mut" | "&" "raw" ("const" | "mut")
suffix = "?" | "." (ID | NUM | "await") ("::" typeargs)? | @args | @index
primary = literal | exprpath | exprpath @structlit | @parens | @array | blocklike | macrocall
macrocall = path "!" @tree
exprpath = path | "<" type ("as" typepath)? ">" ("::" (segment | typeargs))+
closure = "static"? "async"? "move"? ("|" (closureparam ("," closureparam)* ","?)? "|" | "||") ("->" type)? expr
closureparam = patternitem (":" type)?
structlit_whole = (structitem ("," structitem)* ","?)? | (structitem ",")* ".." expr
structitem = attr* (ID | NUM) (":" expr)?
parens_whole = (expr ("," expr)* ","?)?
args_whole = (expr ("," expr)* ","?)?
index_whole = expr
array_whole = (expr ("," expr)* ","?)? | expr ";" expr
"""
RUST_ROLES = {
    "(": {"parens": "parens_whole", "args": "args_whole", "params": "params_whole", "vis": "vis_whole", "tuplefields": "tuplefields_whole", "tupletype": "tupletype_whole", "fntypes": "fntypes_whole", "tuplepat": "tuplepat_whole", "type": "type_whole", "tree": "ANY"},
    "[": {"array": "array_whole", "index": "index_whole", "arraytype": "arraytype_whole", "slicepat": "slicepat_whole", "tree": "ANY"},
    "{": {"block": "block_whole", "fields": "fields_whole", "variants": "variants_whole", "items": "items_whole", "mod": "mod_whole", "uses": "uses_whole", "externs": "externs_whole", "arms": "arms_whole", "structlit": "structlit_whole", "fieldpat": "fieldpat_whole", "tree": "ANY"},
}
RUST_ITEMS = {"args": ("expr", ","), "array": ("expr", ","), "variants": ("variant", ","), "fields": ("fielddef", ","), "block": ("stmts", ";"), "items": ("items_whole", ";"), "externs": ("externs_whole", ";"), "mod": ("mod_whole", ";")}
RUST_KEYWORDS = "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn"

SOLIDITY = r"""
program = top*
top = pragma | import | contract | struct | enum | error | event | function | using | constant ";" | udvt
pragma = "pragma" PRAGMA ";"
import = "import" (STR ("as" name)? | @names "from" STR | "*" "as" name "from" STR) ";"
names_whole = (nameitem ("," nameitem)* ","?)?
nameitem = name ("as" name)?
contract = "abstract"? ("contract" | "interface" | "library") name ("is" base ("," base)*)? @body
base = path @args?
body_whole = part*
part = state ";" | function | constructor | modifierdef | event | error | struct | enum | using | udvt | special
udvt = "type" name "is" type ";"
using = "using" (path | @names) "for" (type | "*") "global"? ";"
state = type ("public" | "private" | "internal" | "constant" | "immutable" | "override" @args? | "transient")* name ("=" expr)?
constant = type "constant" name "=" expr
struct = "struct" name @struct
struct_whole = (type name ";")*
enum = "enum" name @enum
enum_whole = (name ("," name)* ","?)?
event = "event" name @eventparams "anonymous"? ";"
eventparams_whole = (eventparam ("," eventparam)*)?
eventparam = type "indexed"? name?
error = "error" name @params ";"
modifierdef = "modifier" name @params? ("virtual" | "override" @args?)* (@block | ";")
function = "function" name @params attribute* ("returns" @params)? attribute* (@block | ";")
attribute = "public" | "private" | "internal" | "external" | "pure" | "view" | "payable" | "virtual" | "override" @args? | path @args?
constructor = "constructor" @params attribute* @block
special = ("receive" | "fallback") @params attribute* ("returns" @params)? (@block | ";")
params_whole = (param ("," param)*)?
param = type location? name?
location = "memory" | "storage" | "calldata"
type = basetype (@emptyindex | @index)*
basetype = path | "mapping" @mapping | "function" @params attribute* ("returns" @params)? | "address" "payable"? | "var"
mapping_whole = type name? "=>" type name?
path = name ("." name)*
block_whole = stmt*
stmt = @block | "unchecked" @block | "if" @paren stmt ("else" stmt)? | "for" @for stmt | "while" @paren stmt | "do" stmt "while" @paren ";" | "try" expr ("returns" @params)? @block catch+
stmt = "return" expr? ";" | "emit" expr ";" | "revert" expr ";" | "break" ";" | "continue" ";" | "throw" ";" | "_" ";" | "assembly" STR? @args? @yul | local ";" | expr ";" | @tuplelocal "=" expr ";" | "delete" expr ";"
catch = "catch" (name? @params)? @block
local = type location? name ("=" expr)?
tuplelocal_whole = ","* local? (","+ local?)*
for_whole = (local | expr)? ";" expr? ";" expr?
expr = chain ("?" expr ":" expr)?
chain = unary (binary unary)*
binary = "=" | "+=" | "-=" | "*=" | "/=" | "%=" | "|=" | "&=" | "^=" | "<<=" | ">" ">=" | "+" | "-" | "*" | "/" | "%" | "**" | "<<" | ">" ">" | ">" ">" ">" | "<" | ">" | "<=" | ">=" | "==" | "!=" | "&" | "|" | "^" | "&&" | "||"
unary = prefix* primary suffix* ("++" | "--")?
prefix = "!" | "~" | "-" | "+" | "++" | "--" | "delete"
suffix = "." name | "." "address" | @index | @emptyindex | @args | @named | @options
index_whole = expr (":" expr?)? | ":" expr?
args_whole = (expr ("," expr)*)? | @named
named_whole = (name ":" expr ("," name ":" expr)* ","?)?
options_whole = name ":" expr ("," name ":" expr)*
paren_whole = expr
primary = name | NUM unit? | STR+ | "true" | "false" | "this" | "super" | @tuple | @array | "new" type | "type" @typearg | "payable" @args | "address" | "mapping" @mapping
unit = "wei" | "gwei" | "ether" | "seconds" | "minutes" | "hours" | "days" | "weeks" | "years"
tuple_whole = ","* expr? (","+ expr?)*
array_whole = (expr ("," expr)*)?
typearg_whole = type
yul_whole = yulstmt*
yulstmt = @yul | "let" name ("," name)* (":=" yulexpr)? | yulpath ("," yulpath)* ":=" yulexpr | yulexpr | "if" yulexpr @yul | "for" @yul yulexpr @yul @yul | "switch" yulexpr ("case" yulliteral @yul)* ("default" @yul)? | "break" | "continue" | "leave" | "function" name @yulnames ("->" name ("," name)*)? @yul
yulpath = name ("." name)*
yulexpr = yulpath @yulargs? | yulliteral | ("return" | "revert" | "byte" | "address") @yulargs
yulliteral = NUM | STR | "true" | "false"
yulargs_whole = (yulexpr ("," yulexpr)*)?
yulnames_whole = (name ("," name)*)?
name = ID | "from" | "error" | "revert" | "global" | "receive" | "fallback" | "transient" | "leave" | "payable" | "_"
"""
SOLIDITY_ROLES = {
    "(": {"args": "args_whole", "params": "params_whole", "eventparams": "eventparams_whole", "mapping": "mapping_whole", "paren": "paren_whole", "tuplelocal": "tuplelocal_whole", "for": "for_whole", "tuple": "tuple_whole", "typearg": "typearg_whole", "yulargs": "yulargs_whole", "yulnames": "yulnames_whole"},
    "[": {"index": "index_whole", "emptyindex": "EMPTY", "array": "array_whole"},
    "{": {"block": "block_whole", "body": "body_whole", "struct": "struct_whole", "enum": "enum_whole", "names": "names_whole", "named": "named_whole", "options": "options_whole", "yul": "yul_whole"},
}
SOLIDITY_ITEMS = {"args": ("expr", ","), "block": ("block_whole", ";"), "body": ("body_whole", ";"), "struct": ("struct_whole", ";")}
SOLIDITY_KEYWORDS = (
    "pragma import as from abstract contract interface library is using for global public private internal external constant immutable override transient struct enum event anonymous indexed error modifier virtual function returns pure view payable"
    " constructor receive fallback memory storage calldata mapping unchecked if else while do try catch return emit revert break continue throw assembly delete true false this super new type wei gwei ether seconds minutes hours days weeks years let switch case default leave _ address var"
)

C = r"""
program = top*
top = ";" | declaration | fndef | fndecl_old | macrocall
macrocall = ID @args ";"?
fndef = specs pointer* (ID | @declarator) @params attribute* @block
fndecl_old = NEVER
declaration = specs (init ("," init)*)? ";" | "_Static_assert" @args ";"
init = declarator attribute* ("=" initializer)? | declarator ":" cond
initializer = assign | @initlist
specs = mod* base mod*
mod = "typedef" | "extern" | "static" | "auto" | "register" | "inline" | "_Noreturn" | "_Thread_local" | qualifier | attribute
base = ID | builtin (mod* builtin)* | tagged
qualifier = "const" | "volatile" | "restrict" | "_Atomic"
builtin = "void" | "char" | "short" | "int" | "long" | "float" | "double" | "signed" | "unsigned" | "_Bool" | "_Complex"
tagged = ("struct" | "union") attribute* (ID? @fields | ID) | "enum" (ID? @enum | ID) | ("typeof" | "__typeof__") @args
attribute = "__attribute__" @args
fields_whole = field*
field = ";" | specs (fielddecl ("," fielddecl)*)? ";"
fielddecl = declarator (":" cond)? attribute* | ":" cond
enum_whole = (enumitem ("," enumitem)* ","?)?
enumitem = ID ("=" cond)?
declarator = pointer* direct
pointer = "*" qualifier*
direct = (ID | @declarator) (@array | @params)*
declarator_whole = pointer* direct
array_whole = ("static" | qualifier)* (assign | "*")?
params_whole = ("void" | param ("," param)* ("," "...")?)?
param = specs (declarator | abstract)?
abstract = pointer+ abstractdirect? | abstractdirect
abstractdirect = (@abstract | @array | @params) (@array | @params)*
abstract_whole = abstract
typename_whole = qualifier* base qualifier* abstract?
block_whole = stmt*
stmt = @block | ";" | declaration | expr ";" | "if" @paren stmt ("else" stmt)? | "while" @paren stmt | "do" stmt "while" @paren ";" | "for" @for stmt | "switch" @paren stmt | "case" cond ("..." cond)? ":" stmt? | "default" ":" stmt? | ID ":" stmt? | "return" expr? ";" | "break" ";" | "continue" ";" | "goto" ID ";" | ("asm" | "__asm__") qualifier* @any ";"
for_whole = (declaration | expr? ";") expr? ";" expr?
paren_whole = expr
expr = assign ("," assign)*
assign = cond (assignop cond)*
assignop = "=" | "+=" | "-=" | "*=" | "/=" | "%=" | "<<=" | ">>=" | "&=" | "|=" | "^="
cond = chain ("?" expr? ":" cond)?
chain = unary (binary unary)*
binary = "+" | "-" | "*" | "/" | "%" | "<<" | ">>" | "<" | ">" | "<=" | ">=" | "==" | "!=" | "&" | "|" | "^" | "&&" | "||"
unary = prefix* primary suffix*
prefix = "!" | "~" | "-" | "+" | "++" | "--" | "*" | "&" | "sizeof" | @typename
suffix = "." ID | "->" ID | @index | @args | "++" | "--"
primary = ID | NUM | CHAR | STR+ | @paren | @typename @initlist | "sizeof" @typename | "_Generic" @any | "__builtin_offsetof" @any
index_whole = expr
args_whole = (arg ("," arg)*)?
arg = assign | qualifier* base qualifier* abstract?
initlist_whole = (inititem ("," inititem)* ","?)?
inititem = (("." ID | @index)+ "=")? (assign | @initlist)
"""
C_ROLES = {
    "(": {"paren": "paren_whole", "args": "args_whole", "params": "params_whole", "declarator": "declarator_whole", "abstract": "abstract_whole", "typename": "typename_whole", "for": "for_whole", "any": "ANY"},
    "[": {"array": "array_whole", "index": "index_whole"},
    "{": {"block": "block_whole", "fields": "fields_whole", "enum": "enum_whole", "initlist": "initlist_whole"},
}
C_ITEMS = {"args": ("arg", ","), "initlist": ("inititem", ","), "enum": ("enumitem", ","), "block": ("block_whole", ";"), "fields": ("fields_whole", ";")}
C_KEYWORDS = "typedef extern static auto register inline _Noreturn _Thread_local const volatile restrict _Atomic void char short int long float double signed unsigned _Bool _Complex struct union enum typeof __typeof__ __attribute__ _Static_assert if else while do for switch case default return break continue goto asm __asm__ sizeof _Generic __builtin_offsetof"
