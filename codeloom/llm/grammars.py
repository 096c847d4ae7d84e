"""Grammars of the four languages, for recognition by derivatives.

Each rule list is an own, flat statement of the public language definitions
(ECMAScript modules, TypeScript, Python 3.12, PHP 8.3): binary operators are
one chain, since precedence doesn't change whether a text parses.
"""

from __future__ import annotations

# Words that may also be plain names in JavaScript and TypeScript.
SOFT_JS = "async of get set as from"
SOFT_TS = SOFT_JS + " type declare namespace module abstract readonly keyof infer is asserts satisfies unique global accessor out override require"
STRICT = "static private protected public interface"
HARD = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let await implements package"


def _any(words: str) -> str:
    return " | ".join(f"'{w}'" for w in words.split())


_BINARY = "'+' | '-' | '*' | '/' | '%' | '**' | '&' | 'BAR' | '^' | '<' | '>' | '>=' | '<=' | '<<' | '==' | '!=' | '===' | '!==' | 'in' | 'instanceof' | '>' '>' | '>' '>' '>'"


def ecmascript(ts: bool) -> str:
    """The rules of JavaScript modules, with TypeScript's on top where asked for."""
    rules = [
        "Module = Item*",
        "End = ';' | 'ASI'",
        f"Ident = 'ID' | {_any(SOFT_TS if ts else SOFT_JS)}",
        f"Word = Ident | {_any(HARD + ' ' + STRICT)}",
        "PropName = Word | 'STR' | 'NUM' | '[' Assign ']'",
        "Item = Import | Export | Stmt",
        "Block = '{' Stmt* '}'",
        "Import = 'import' ImportRest End | 'import' 'STR' With? End",
        "With = 'with' Object",
        "ImportRest = ImportTypeWord? (Ident (',' (NameSpace | NamedImports))? | NameSpace | NamedImports) 'from' 'STR' With?",
        "NameSpace = '*' 'as' Ident",
        "NamedImports = '{' (ImportSpec (',' ImportSpec)* ','?)? '}'",
        "ImportSpec = ImportTypeWord? (Word 'as' Ident | Ident | 'STR' 'as' Ident)",
        "ExportSpec = ImportTypeWord? (Word | 'STR') ('as' (Word | 'STR'))?",
        "Export = 'export' ExportRest | Decorators 'export' ('default')? Class",
        "ExportRest = VarDecl End | Func | Decorators? Class | 'default' (Func | FuncAnon | Decorators? AnyClass | AssignS End) | ImportTypeWord? '*' ('as' (Word | 'STR'))? 'from' 'STR' With? End | ImportTypeWord? '{' (ExportSpec (',' ExportSpec)* ','?)? '}' ('from' 'STR' With?)? End" + (" | TsDecl | '=' Assign End | 'as' 'namespace' Ident End | 'import' Ident '=' EntityOrRequire End | 'default' Interface" if ts else ""),
        "Stmt = Block | ';' | VarDecl End | Func | Class | If | For | While | Do | Jump | Try | Switch | Label | ExprS End | 'debugger' End | Decorators Class" + (" | TsDecl" if ts else ""),
        "Label = Ident ':' Stmt",
        "If = 'if' '(' Expr ')' Stmt ('else' Stmt)?",
        "While = 'while' '(' Expr ')' Stmt",
        "Do = 'do' Stmt 'while' '(' Expr ')' End?",
        "For = 'for' 'await'? '(' ForHead ')' Stmt",
        "ForHead = VarKind Target ('of' Assign | 'in' Expr) | (VarDecl | Expr)? ';' Expr? ';' Expr? | (Lhs | Array | ObjectTo) ('of' Assign | 'in' Expr)",
        "Jump = 'return' Expr? End | 'break' Ident? End | 'continue' Ident? End | 'throw' Expr End",
        "Try = 'try' Block (Catch Finally? | Finally)",
        "Catch = 'catch' ('(' Target ')')? Block",
        "Finally = 'finally' Block",
        "Switch = 'switch' '(' Expr ')' '{' ('case' Expr ':' Stmt* | 'default' ':' Stmt*)* '}'",
        "VarKind = 'var' | 'let' | 'const'",
        "VarDecl = ('var' | 'let') VarOne (',' VarOne)* | 'const' ConstOne (',' ConstOne)*",
        "VarOne = Ident" + (" 'BANG'?" if ts else "") + " Annot? ('=' Assign)? | Pattern Annot? '=' Assign",
        "ConstOne = Target '=' Assign",
        "Target = (Ident | Pattern) Annot?",
        "Pattern = ObjPattern | ArrPattern",
        "ObjPattern = '{' (ObjPatItem (',' ObjPatItem)* (',' ObjPatRest?)? | ObjPatRest)? '}'",
        "ObjPatItem = Ident ('=' Assign)? | PropName ':' PatElem | ObjPatRest",
        "ObjPatRest = '...' PatTarget",
        "PatTarget = Ident | Pattern",
        "PatElem = PatTarget ('=' Assign)?",
        "ArrPattern = '[' ','* ((PatElem | '...' PatTarget) (',' (PatElem | '...' PatTarget)?)*)? ']'",
        "Params = '(' (Param (',' Param)* ','?)? ')'",
        "Func = 'async'? 'function' '*'? Ident TypeParams? Params Ret? Body",
        "FuncAnon = 'async'? 'function' '*'? TypeParams? Params Ret? Block",
        "FuncExpr = 'async'? 'function' '*'? Ident? TypeParams? Params Ret? Block",
        "ClassHead = 'class' Ident? ClassTail",
        "ClassNamed = 'class' Ident ClassTail",
        "ClassTail = TypeParams? ('extends' Heritage)? Implements? '{' Member* '}'",
        "Heritage = Chain" + (" TypeArgs?" if ts else ""),
        "Method = ('async'? '*'? | 'get' | 'set') MethodName Optional? TypeParams? Params Ret? Body",
        "MethodName = PropName | 'PRIV'",
        "Field = MethodName FieldMark? Annot? ('=' Assign)? End",
        "Args = '(' ((Assign | '...' Assign) (',' (Assign | '...' Assign))* ','?)? ')'",
        "Array = '[' ','* ((To | '...' To) (',' (To | '...' To)?)*)? ']'",
        "Object = '{' (ObjItem (',' ObjItem)* ','?)? '}'",
        "ObjItem = Ident | PropName ':' Assign | ('async'? '*'? | 'get' | 'set') PropName TypeParams? Params Ret? Block | '...' Assign",
        # What stands left of an equals sign may have values by default; an array's objects may anywhere.
        "ObjectTo = '{' (ToItem (',' ToItem)* ','?)? '}'",
        "ToItem = Ident ('=' Assign)? | PropName ':' To | '...' To",
        "To = Assign | ObjectTo",
        "Template = 'TPL' | 'TPLHEAD' Expr ('TPLMID' Expr)* 'TPLTAIL'",
        "Suffix = '.' (Word | 'PRIV') | '?.' (Word | 'PRIV' | '[' Expr ']' | Args) | '[' Expr ']' | Args | Template" + (" | 'BANG' | TypeArgs (Args | Template)" if ts else ""),
        "Member2 = '.' (Word | 'PRIV') | '[' Expr ']'",
        f"Binary = {_BINARY}",
        "Logic = Binary | '&&' | 'OROR'".replace("'OROR'", "'||'"),
        "Nullish = Binary | '??'",
        "AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&&=' | '||=' | '??='",
        "UnOp = '!' | '-' | '+' | '~' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--'" + (" | '<' (Type | 'const') '>'" if ts else ""),
        "Arrow = 'async'? (Ident | TypeParams? Params Ret?) '=>' (Block | AssignB)",
        "Yield = 'yield' ('*' Assign | Assign)?",
        "Expr = Assign (',' Assign)*",
        "ExprS = AssignS (',' Assign)*",
        "Rest = " + ("((Logic Unary | As)* | (Nullish Unary | As)*) ('?' Assign ':' Assign)?" if ts else "((Logic Unary)* | (Nullish Unary)*) ('?' Assign ':' Assign)?"),
        "Lit = 'NUM' | 'STR' | 'REGEX' | 'true' | 'false' | 'null' | 'this' | 'super' | 'import' '.' Word | 'import' Args | 'new' '.' Word | 'PRIV' 'in' Unary",
        "Paren = '(' Expr ')'",
    ]
    if ts:
        rules += [
            "ImportTypeWord = 'type'",
            "As = ('as' | 'satisfies') (Type | 'const')",
            "Annot = ':' Type",
            "Optional = '?'",
            "FieldMark = '?' | 'BANG'",
            "Ret = ':' (Type | 'asserts'? (Ident | 'this') ('is' Type)?)",
            "Body = Block | End",
            "Decorators = ('@' Chain)+",
            "Param = Decorators? ('public' | 'private' | 'protected' | 'readonly' | 'override')* ('...' Target | (Ident | Pattern | 'this') '?'? Annot? ('=' Assign)?)",
            "Class = 'declare'? 'abstract'? ClassNamed",
            "AnyClass = 'abstract'? ClassHead",
            "Implements = 'implements' Type (',' Type)*",
            "Modifier = 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'override' | 'readonly' | 'declare' | 'accessor'",
            "Member = ';' | Decorators? Modifier* (Method | Field) | 'static' Block | Modifier* IndexSig End",
            "TypeParams = '<' TypeParam (',' TypeParam)* ','? '>'",
            "TypeParam = ('const' | 'in' | 'out')* Ident ('extends' Type)? ('=' Type)?",
            "TypeArgs = '<' Type (',' Type)* '>'",
            "Type = Union ('extends' Union '?' Type ':' Type)? | FuncType",
            "FuncType = 'abstract'? 'new'? TypeParams? TypeParamsList '=>' (Type | 'asserts'? (Ident | 'this') 'is' Type)",
            "TypeParamsList = '(' (Param (',' Param)* ','?)? ')'",
            "Union = ('BAR' | '&')? UnTerm (('BAR' | '&') UnTerm)*",
            "UnTerm = ('keyof' | 'unique' | 'readonly')* (Postfixed | 'infer' Ident ('extends' Union)?)",
            "Postfixed = PrimaryType ('[' Type? ']')*",
            "PrimaryType = '(' Type ')' | Ident ('.' Word)* TypeArgs? | 'this' | 'void' | 'null' | 'true' | 'false' | 'STR' | '-'? 'NUM' | TplType | ObjType | Tuple | 'typeof' (Ident | 'this' | 'import' '(' 'STR' ')') ('.' Word)* TypeArgs? | 'import' '(' 'STR' ')' ('.' Word)* TypeArgs?",
            "TplType = 'TPL' | 'TPLHEAD' Type ('TPLMID' Type)* 'TPLTAIL'",
            "Tuple = '[' (TupleItem (',' TupleItem)* ','?)? ']'",
            "TupleItem = '...'? (Ident '?'? ':')? Type '?'?",
            "ObjType = '{' (TypeMember ((';' | ',' | 'ASI') TypeMember)* (';' | ',' | 'ASI')?)? '}' | Mapped",
            "TypeMember = 'readonly'? PropName '?'? Annot? | ('get' | 'set')? PropName '?'? TypeParams? Params Ret? | TypeParams? Params Ret? | 'new' TypeParams? Params Ret? | IndexSig",
            "IndexSig = 'readonly'? '[' Ident ':' Type ']' ':' Type",
            "Mapped = '{' (('+' | '-')? 'readonly')? '[' Ident 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? Annot? (';' | ',' | 'ASI')? '}'",
            "Interface = 'interface' Ident TypeParams? ('extends' Type (',' Type)*)? ObjType",
            "TsDecl = 'declare'? (Interface | 'type' Ident TypeParams? '=' Type End | 'const'? 'enum' Ident '{' (EnumItem (',' EnumItem)* ','?)? '}') | 'declare' (Ambient | Func | 'global' AmbientBody | 'module' 'STR' (AmbientBody | End) | ('namespace' | 'module') Ident ('.' Ident)* AmbientBody) | ('namespace' | 'module') Ident ('.' Ident)* NsBody | 'import' Ident '=' EntityOrRequire End",
            "NsBody = '{' Item* '}'",
            "AmbientBody = '{' (Item | 'export'? Ambient | 'export'? ('namespace' | 'module') Ident ('.' Ident)* AmbientBody)* '}'",
            "Ambient = VarKind AmbientOne (',' AmbientOne)* End",
            "AmbientOne = Target ('=' Assign)?",
            "EntityOrRequire = 'require' '(' 'STR' ')' | Ident ('.' Word)*",
            "EnumItem = (Word | 'STR') ('=' Assign)?",
        ]
    else:
        never = "'NEVER'"
        rules += [
            f"ImportTypeWord = {never}", f"Annot = {never}", f"Optional = {never}", f"FieldMark = {never}", f"Ret = {never}", "Body = Block", f"Decorators = {never}",
            "Param = '...' Target | Target ('=' Assign)?", "Class = ClassNamed", "AnyClass = ClassHead", f"Implements = {never}", "Member = ';' | 'static'? (Method | Field) | 'static' Block", f"TypeParams = {never}",
        ]
    bang = " 'BANG'?" if ts else ""
    # Variants by what an expression may begin with: anything, no brace (B), neither brace nor function nor class (S).
    for v in ("", "B", "S"):
        base = ["Ident", "Lit", "Paren", "Array", "Template", "'new' Chain"] + (["Object"] if v == "" else []) + (["FuncExpr", "Decorators? ClassHead"] if v != "S" else [])
        rules += [
            f"Base{v} = {' | '.join(base)}",
            f"Chain{v} = Base{v} Suffix*",
            f"Post{v} = Chain{v} ('++' | '--')?",
            f"Unary{v} = Post{v} | UnOp+ Post",
            f"Lhs{v} = Ident{bang} | Base{v} Suffix* Member2{bang}",
            f"Assign{v} = Unary{v} Rest | Lhs{v} AssignOp Assign | " + ("(Array | ObjectTo)" if v == "" else "Array") + " '=' Assign | Arrow | Yield",
        ]
    return "\n".join(rules)


PY_SOFT = "match case type _"
PY_HARD = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"

PYTHON = f"""
File = ('NEWLINE' | Stmt)*
Name = 'ID' | {_any(PY_SOFT)}
Stmt = Simple | Compound
Simple = Small (';' Small)* ';'? 'NEWLINE'
Block = Simple | 'NEWLINE' 'INDENT' Stmt+ 'DEDENT'
Small = Star | Targets '=' AssignRest | AugTarget AugOp (Star | Yield) | AugTarget ':' Test ('=' (Star | Yield))? | Yield | 'pass' | 'break' | 'continue' | 'return' Star? | 'raise' (Test ('from' Test)?)? | 'global' Name (',' Name)* | 'nonlocal' Name (',' Name)* | 'del' Targets | 'assert' Test (',' Test)? | Import | 'type' Name TypeParams? '=' Test
AssignRest = Star | Yield | Targets '=' AssignRest
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Import = 'import' Dotted ('as' Name)? (',' Dotted ('as' Name)?)* | 'from' ('.' | '...')* Dotted? 'import' ('*' | ImportNames | '(' ImportNames ','? ')')
ImportNames = Name ('as' Name)? (',' Name ('as' Name)?)*
Dotted = Name ('.' Name)*
Targets = StarTarget (',' StarTarget)* ','?
StarTarget = '*'? Target
Target = AugTarget | '(' Targets? ')' | '[' Targets? ']'
AugTarget = Name | '(' AugTarget ')' | Atom Trailer* ('.' Name | '[' Subs ']')
Trailer = '.' Name | '[' Subs ']' | '(' Args? ')'
Subs = Sub (',' Sub)* ','?
Sub = Named | '*' Or | Test? ':' Test? (':' Test?)?
Args = Named CompFor | ArgList
ArgList = (Named | '*' Test) (',' ArgList?)? | KeyArgs
KeyArgs = Name '=' Test (',' (KeyArgs | '*' Test (',' AfterStar?)?)?)? | '**' Test (',' MapArgs?)?
AfterStar = KeyArgs | '*' Test (',' AfterStar?)?
MapArgs = (Name '=' Test | '**' Test) (',' MapArgs?)?
Star = StarItem (',' StarItem)* ','?
StarItem = Named0 | '*' Or
Named0 = Test
Named = (Name ':=')? Test
Test = OrTest ('if' OrTest 'else' Test)? | Lambda
Lambda = 'lambda' LambdaParams? ':' Test
LambdaParams = Name (',' LRest?)? | LGiven | LStar
LRest = LambdaParams | '/' (',' LRest?)?
LGiven = Name '=' Test (',' (LGiven | '/' (',' (LGiven | LStar)?)? | LStar)?)?
LStar = '*' Name (',' (LKey | LMap)?)? | '*' ',' LKey | LMap
LKey = Name ('=' Test)? (',' (LKey | LMap)?)?
LMap = '**' Name ','?
OrTest = NotTest (('and' | 'or') NotTest)*
NotTest = 'not'* Compare
Compare = Or (CompOp Or)*
CompOp = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
Or = Factor (BinOp Factor)*
BinOp = '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'
Factor = ('+' | '-' | '~')* 'await'? Atom Trailer*
Atom = Name | 'NUM' | String+ | '...' | 'None' | 'True' | 'False' | '(' (Yield | ParenBody)? ')' | '[' ListBody? ']' | '{{' DictBody? '}}'
String = 'STR' | 'FSTR' ('F{{' (Star | Yield) 'F}}')* 'FEND'
ParenBody = ListItem (CompFor | (',' ListItem)* ','?)
ListBody = ListItem (CompFor | (',' ListItem)* ','?)
ListItem = Named | '*' Or
DictBody = DictItem (CompFor | (',' DictItem)* ','?) | ListItem (CompFor | (',' ListItem)* ','?)
DictItem = Test ':' Test | '**' Or
CompFor = ('async'? 'for' Targets 'in' OrTest CompRest ('if' CompCond)*)+
CompRest = ('if' OrTest 'else' Test)?
CompCond = (Name ':=')? OrTest | Lambda
Yield = 'yield' ('from' Test | Star)?
Compound = If | 'while' Named ':' Block Else? | 'async'? 'for' Targets 'in' Star ':' Block Else? | Try | 'async'? 'with' WithItems ':' Block | Decorator* (Def | Class) | Match
Decorator = '@' Named 'NEWLINE'
If = 'if' Named ':' Block ('elif' Named ':' Block)* Else?
Else = 'else' ':' Block
Try = 'try' ':' Block (Except+ Else? Finally? | ExceptStar+ Else? Finally? | Finally)
Except = 'except' (Test ('as' Name)?)? ':' Block
ExceptStar = 'except' '*' Test ('as' Name)? ':' Block
Finally = 'finally' ':' Block
WithItems = WithItem (',' WithItem)* | '(' WithItem (',' WithItem)* ','? ')'
WithItem = Test ('as' Target)?
Def = 'async'? 'def' Name TypeParams? '(' Params? ')' ('->' Test)? ':' Block
TypeParams = '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam = ('*' | '**')? Name (':' Test)?
Params = Param (',' Rest?)? | Given | Star2
Param = Name (':' Test)?
Rest = Params | '/' (',' Rest?)?
Given = Param '=' Test (',' (Given | '/' (',' (Given | Star2)?)? | Star2)?)?
Star2 = '*' Name (':' StarItem)? (',' (Key | Map)?)? | '*' ',' Key | Map
Key = Param ('=' Test)? (',' (Key | Map)?)?
Map = '**' Param ','?
Class = 'class' Name TypeParams? ('(' ArgList? ')')? ':' Block
Match = 'match' Star ':' 'NEWLINE' 'INDENT' Case+ 'DEDENT'
Case = 'case' Patterns ('if' Named)? ':' Block
Patterns = StarPat (',' StarPat)* ','?
StarPat = '*' Name | Pat
Pat = ClosedPat ('|' ClosedPat)* ('as' Name)?
ClosedPat = '-'? 'NUM' (('+' | '-') 'NUM')? | String+ | 'None' | 'True' | 'False' | Dotted ('(' (PatArg (',' PatArg)* ','?)? ')')? | '(' Patterns? ')' | '[' Patterns? ']' | '{{' (MapPat (',' MapPat)* ','?)? '}}'
PatArg = Pat | Name '=' Pat
MapPat = ('-'? 'NUM' | String+ | 'None' | 'True' | 'False' | Dotted) ':' Pat | '**' Name
"""

PHP_HARD = "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield die eval"

PHP = f"""
File = 'HTML'? ('OPEN' Top*)? | 'HTML'? 'OPEN' Top* 'ECHOOPEN'
Word = 'ID' | 'enum' | 'self' | {_any(PHP_HARD)}
End = ';' | 'CLOSE'
Id = 'ID' | 'enum' | 'self' | 'readonly'
QName = Id | 'QNAME' | 'namespace' 'QNAME'
Top = Stmt | Use | Namespace | ConstDecl | '__halt_compiler' '(' ')' ';'
Namespace = 'namespace' QName End | 'namespace' QName? '{{' Top* '}}'
Use = 'use' ('function' | 'const')? UseItem (',' UseItem)* End | 'use' ('function' | 'const')? 'QNAME' '{{' UseIn (',' UseIn)* ','? '}}' End | 'use' ('function' | 'const')? QName '\\' '{{' UseIn (',' UseIn)* ','? '}}' End
UseItem = QName ('as' Id)?
UseIn = ('function' | 'const')? QName ('as' Id)?
ConstDecl = 'const' Id '=' Expr (',' Id '=' Expr)* End
Block = '{{' Inner* '}}'
Inner = Stmt
Stmt = Block | End | If | For | Foreach | While | Do | Switch | Try | Jump | Echo | Func | Class | Static | Global | Unset | Declare | Id ':' | 'goto' Id End | Expr End | 'HTMLX'
If = 'if' '(' Expr ')' (Stmt ('elseif' '(' Expr ')' Stmt | 'else' 'if' '(' Expr ')' Stmt)* ('else' Stmt)? | ':' Inner* ('elseif' '(' Expr ')' ':' Inner*)* ('else' ':' Inner*)? 'endif' End)
For = 'for' '(' Exprs? ';' Exprs? ';' Exprs? ')' (Stmt | ':' Inner* 'endfor' End)
Foreach = 'foreach' '(' Expr 'as' (('&'? Expr) | Expr '=>' '&'? Expr) ')' (Stmt | ':' Inner* 'endforeach' End)
While = 'while' '(' Expr ')' (Stmt | ':' Inner* 'endwhile' End)
Do = 'do' Stmt 'while' '(' Expr ')' End
Switch = 'switch' '(' Expr ')' ('{{' ';'? Case* '}}' | ':' Case* 'endswitch' End)
Case = ('case' Expr | 'default') (':' | ';') Inner*
Try = 'try' Block (Catch+ Finally? | Finally)
Catch = 'catch' '(' QName ('|' QName)* 'VAR'? ')' Block
Finally = 'finally' Block
Jump = 'return' Expr? End | 'break' 'NUM'? End | 'continue' 'NUM'? End
Echo = 'echo' Exprs End
Static = 'static' StaticVar (',' StaticVar)* End
StaticVar = 'VAR' ('=' Expr)?
Global = 'global' 'VAR' (',' 'VAR')* End
Unset = 'unset' '(' Exprs ','? ')' End
Declare = 'declare' '(' Id '=' Expr (',' Id '=' Expr)* ')' (End | Block | ':' Inner* 'enddeclare' End)
Exprs = Expr (',' Expr)*
Attrs = ('#[' Attr (',' Attr)* ','? ']')*
Attr = QName Args?
Func = Attrs 'function' '&'? (Id | 'enum') Params Ret? Block
Ret = ':' Type
Type = '?' TypeAtom | TypeAtom ('|' TypeAtom)* | TypeAtom ('&' TypeAtom)*
TypeAtom = QName | 'array' | 'callable' | 'static' | '(' TypeAtom ('&' TypeAtom)* ')'
Params = '(' (Param (',' Param)* ','?)? ')'
Param = Attrs ('public' | 'protected' | 'private' | 'readonly')* Type? '&'? '...'? 'VAR' ('=' Expr)?
Class = Attrs ('abstract' | 'final' | 'readonly')* 'class' Id ('extends' QName)? ('implements' QName (',' QName)*)? Members | Attrs 'interface' Id ('extends' QName (',' QName)*)? Members | Attrs 'trait' Id Members | Attrs 'enum' Id (':' Type)? ('implements' QName (',' QName)*)? Members
Members = '{{' Member* '}}'
Mod = 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'readonly' | 'var'
Member = Attrs Mod* 'function' '&'? Word Params Ret? (Block | ';') | Attrs Mod+ Type? PropOne (',' PropOne)* ';' | Attrs Mod* 'const' ConstOne (',' ConstOne)* ';' | Attrs Mod* 'const' Type ConstOne (',' ConstOne)* ';' | 'use' QName (',' QName)* (';' | '{{' Adapt* '}}') | Attrs 'case' Word ('=' Expr)? ';'
Adapt = (QName '::')? Word ('as' ('public' | 'protected' | 'private')? Word? | 'insteadof' QName (',' QName)*) ';'
PropOne = 'VAR' ('=' Expr)?
ConstOne = Word '=' Expr
Args = '(' (ArgOne (',' ArgOne)* ','?)? ')'
ArgOne = (Word ':')? Expr | '...' Expr?
Expr = Unary (Binary Unary)* (Binary (Expr2 | Fn | Lvalue AssignOp Expr))? ('?' Expr? ':' Expr)? | Lvalue AssignOp Expr | Lvalue '=' '&' Expr | ArrayLit '=' Expr | Fn | 'yield' (Expr ('=>' Expr)?)? | 'yield' 'from' Expr | 'throw' Expr | 'print' Expr | ('include' | 'include_once' | 'require' | 'require_once') Expr
Binary = '+' | '-' | '*' | '/' | '%' | '**' | '.' | '<<' | '>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '<>' | '<=>' | '&' | '|' | '^' | '&&' | '||' | '??' | 'and' | 'or' | 'xor' | 'instanceof'
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '.=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '??='
UnOp = '!' | '-' | '+' | '~' | '@' | '&' | 'CAST' | '++' | '--' | 'clone' | 'new'
Unary = UnOp* Post | UnOp+ (Lvalue AssignOp Expr | Fn | Expr2)
Expr2 = ('include' | 'include_once' | 'require' | 'require_once' | 'print' | 'throw') Expr
Post = Chain ('++' | '--')?
Chain = Base Suffix*
Base = 'VAR' | VarVar | 'NUM' | String | QName | 'static' | ArrayLit | 'array' Args2 | 'list' Args2 | '(' Expr ')' | 'isset' '(' Exprs ','? ')' | 'empty' '(' Expr ')' | ('exit' | 'die') ('(' Expr? ')')? | 'eval' '(' Expr ')' | Match | Attrs 'static'? 'function' '&'? Params ('use' '(' (UseVar (',' UseVar)* ','?)? ')')? Ret? Block | Attrs 'readonly'? 'class' Args? ('extends' QName)? ('implements' QName (',' QName)*)? Members
UseVar = '&'? 'VAR'
VarVar = '$' (VarVar | 'VAR' | '{{' Expr '}}')
String = 'STR' | 'ISTR' ('I{{' Expr 'I}}')* 'IEND'
Args2 = '(' Items ')'
ArrayLit = '[' Items ']'
Items = Item? (',' Item?)*
Item = '&'? Expr | Expr '=>' '&'? Expr | '...' Expr
Suffix = '[' Expr? ']' | '{{' Expr '}}' | ('->' | '?->') (Word | 'VAR' | VarVar | '{{' Expr '}}') | '::' (Word | 'VAR' | VarVar | '{{' Expr '}}') | Args
Lvalue = 'VAR' | VarVar | Base Suffix* ('[' Expr? ']' | ('->' | '?->') (Word | 'VAR' | VarVar | '{{' Expr '}}') | '::' ('VAR' | VarVar)) | 'list' Args2
Fn = Attrs 'static'? 'fn' '&'? Params Ret? '=>' Expr
Match = 'match' '(' Expr ')' '{{' (MatchArm (',' MatchArm)* ','?)? '}}'
MatchArm = ('default' ','? | Exprs ','?) '=>' Expr
"""
