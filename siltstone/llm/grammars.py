"""Grammars of the dialects of problem 6, in the notation of ``gll.Grammar``."""

from __future__ import annotations

_JS = r"""
Stmts ~; List
List = ( Stmt | ';' | 'NL' )*
End = ';' | 'NL'
N = 'NL'*
Stmt = B:Stmts | Decl End | FnDecl | ClassDecl | Import End | Export | Jump End | Expr End | Name ':' N Sub
Stmt = 'if' P:Expr N Sub ( N 'else' N Sub )? | 'for' 'await'? P:ForHead N Sub | 'while' P:Expr N Sub | 'do' N Sub N 'while' P:Expr End?
Stmt = 'switch' P:Expr B:Cases | 'try' B:Stmts N ( Catch N Finally | Catch | Finally ) | 'debugger' End
Sub = Stmt | ';'
Catch = 'catch' P:CatchParam? B:Stmts
CatchParam = Target TypeAnn
Finally = 'finally' B:Stmts
Jump = 'return' Expr? | 'throw' Expr | 'break' Name? | 'continue' Name?
Cases = ( 'NL' | 'case' Expr ':' List | 'default' ':' List )*
Decl = 'var' Declr ( ',' Declr )* | 'let' Declr ( ',' Declr )* | 'const' DeclInit ( ',' DeclInit )*
Declr = Name TypeAnn ( '=' Assign )? | Pattern TypeAnn '=' Assign
DeclInit = Target TypeAnn '=' Assign
Target = Name | Pattern
Pattern = S:Elems | B:Props
ForHead = ( Decl | Expr )? ';' Expr? ';' Expr? | ForVar? Target 'of' Assign | ForVar? Target 'in' Expr | Call 'of' Assign | Call 'in' Expr
ForVar = 'var' | 'let' | 'const'
FnDecl = 'async'? 'function' '*'? Name TypeParams P:Params RetType B:Stmts
FnExpr = 'async'? 'function' '*'? Name? TypeParams P:Params RetType B:Stmts
Params ~, Param
Param = Decorator* ParamMod* '...'? Target '?'? TypeAnn ( '=' Assign )?
ClassDecl = Decorator* 'abstract'? 'class' Name TypeParams Heritage B:Members
ClassExpr = 'class' Name? TypeParams Heritage B:Members
Heritage = ( 'extends' Call TypeArgs? )? Implements
Members ~; MemberList
MemberList = ( Member | ';' | 'NL' )*
Member = Decorator* Mod* Accessor? '*'? Key '?'? TypeParams P:Params RetType B:Stmts | Decorator* Mod* Key Mark? TypeAnn ( '=' Assign )? End | 'static' B:Stmts
Mark = '?' | '!'
Accessor = 'get' | 'set' | 'async'
Key = Word | STR | NUM | S:Assign | PRIV
Import = 'import' STR | 'import' TypeOnly? Clause 'from' STR
Clause = Name ( ',' ( '*' 'as' Name | B:Specs ) )? | '*' 'as' Name | B:Specs
Specs ~, Spec
Spec = TypeOnly? ( Word | STR ) ( 'as' ( Word | STR ) )?
Export = 'export' ( Decl End | FnDecl | ClassDecl | 'default' ( FnExpr | Decorator* 'abstract'? ClassExpr | Assign End ) | TypeOnly? B:Specs ( 'from' STR )? End | '*' ( 'as' Word )? 'from' STR End )
Expr = Assign ( ',' Assign )*
Assign = Cond | Arrow | Call AssignOp Assign | Pattern '=' Assign | 'yield' | 'yield' '*'? Assign
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | '>' '>' '=' | '>' '>' '>' '='
Arrow = 'async'? Name '=>' Body | 'async'? TypeParams P:Params RetType '=>' Body
Body = B:Stmts | Assign
Cond = Bin ( '?' Assign ':' Assign )?
Bin = Unary ( BinOp Unary )*
BinOp = '+' | '-' | '*' | '/' | '%' | '**' | '<' | '<=' | '>' | '>' '=' | '==' | '!=' | '===' | '!==' | '&' | '|' | '^' | '&&' | '||' | '??' | '<<' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof'
Unary = UnOp* Postfix
UnOp = '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await'
Postfix = Call ( '++' | '--' )? AsType
Call = Primary Suffix*
Suffix = '.' Word | '.' PRIV | '?.' ( Word | PRIV | P:Args | S:Expr | TPL ) | S:Expr | P:Args | TPL
Primary = Name | NUM | STR | TPL | RE | 'this' | 'super' | 'null' | 'true' | 'false' | P:Expr | S:Elems | B:Props | FnExpr | Decorator* ClassExpr | 'new' Primary | 'new' '.' Word | 'import' P:Args | 'import' '.' Word | PRIV
Args ~, Arg
Arg = '...'? Assign
Elems ~0 Arg
Props ~, Prop
Prop = '...' Assign | Key ':' Assign | Name ( '=' Assign )? | Accessor? '*'? Key TypeParams P:Params RetType B:Stmts
Name = ID | 'async' | 'get' | 'set' | 'of' | 'from' | 'as' | 'accessor'
Word = Name | WORD | 'default' | 'static' | 'new' | 'delete' | 'class' | 'let' | 'await' | 'yield' | 'in' | 'this' | 'super' | 'null' | 'true' | 'false' | 'enum' | 'import' | 'export' | 'return' | 'type' | 'public' | 'private' | 'protected' | 'package' | 'interface' | 'implements' | 'const' | 'var' | 'function' | 'catch' | 'finally' | 'void' | 'typeof' | 'with' | 'for' | 'if' | 'do' | 'case'
Decorator = '@' Call 'NL'*
"""

_PLAIN = r"""
TypeAnn =
TypeParams =
RetType =
Implements =
Mod = 'static' | 'accessor'
ParamMod = NEVER
TypeOnly = NEVER
TypeArgs = NEVER
AsType =
"""

_TS = r"""
Name = 'type' | 'declare' | 'abstract' | 'readonly' | 'namespace' | 'module' | 'keyof' | 'infer' | 'is' | 'asserts' | 'unique' | 'override' | 'satisfies' | 'accessor' | 'global'
TypeAnn = ( ':' Type )?
RetType = ( ':' Type )?
Implements = ( 'implements' Type ( ',' Type )* )?
Mod = 'static' | 'accessor' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'
ParamMod = 'public' | 'private' | 'protected' | 'readonly' | 'override'
TypeOnly = 'type'
TypeArgs = '<' Type ( ',' Type )* '>'
TypeParams = ( '<' TypeParam ( ',' TypeParam )* ','? '>' )?
TypeParam = 'const'? 'in'? Name ( 'extends' Type )? ( '=' Type )?
AsType = ( 'as' ( Type | 'const' ) | 'satisfies' Type )*
Suffix = '!' | TypeArgs P:Args | TypeArgs TPL
Primary = 'new' Primary TypeArgs | '<' Type '>' Unary
Stmt = 'interface' Name TypeParams ( 'extends' Type ( ',' Type )* )? B:TypeMembers | TypeAlias End | Enum | Space | 'declare' DeclareStmt | FnHead End | 'import' Name '=' Expr End
DeclareStmt = Stmt | 'global' B:Stmts
FnHead = 'async'? 'function' Name TypeParams P:Params RetType
TypeAlias = 'type' Name TypeParams '=' Type
Enum = 'const'? 'enum' Name B:EnumMembers
EnumMembers ~, EnumMember
EnumMember = Key ( '=' Assign )?
Space = ( 'namespace' | 'module' ) ( QName | STR ) B:Stmts
Export = 'export' ( 'interface' Name TypeParams ( 'extends' Type ( ',' Type )* )? B:TypeMembers | TypeAlias End | Enum | Space | 'declare' DeclareStmt | FnHead End | '=' Expr End )
Member = Decorator* Mod* Accessor? Key '?'? TypeParams P:Params RetType End | Mod* S:IndexSig TypeAnn End
IndexSig = Name ':' Type | Name 'in' Type ( 'as' Type )?
Type = Union | Union 'extends' Type '?' Type ':' Type | 'abstract'? 'new'? TypeParams P:Params '=>' Type | Name 'is' Type | 'this' 'is' Type | 'asserts' Name ( 'is' Type )?
Union = '|'? Inter ( '|' Inter )*
Inter = '&'? TPost ( '&' TPost )*
TPost = TPre* TPrim S:TypeOpt*
TPre = 'keyof' | 'typeof' | 'readonly' | 'unique' | 'infer'
TypeOpt = Type?
TPrim = QName TypeArgs? | STR | NUM | '-' NUM | TPL | 'null' | 'void' | 'this' | 'true' | 'false' | P:Type | S:TypeElems | B:TypeMembers | 'import' P:Args ( '.' QName )? TypeArgs?
QName = Name ( '.' Word )*
TypeElems ~, TypeElem
TypeElem = '...'? ( Name '?'? ':' )? Type '?'?
TypeMembers = TMSep* ( TypeMember ( TMSep+ TypeMember )* )? TMSep*
TMSep = ';' | ',' | 'NL'
TypeMember = TMod* Key '?'? TypeAnn | 'readonly'? Accessor? Key '?'? TypeParams P:Params RetType | 'new'? TypeParams P:Params RetType | TMod* S:IndexSig '?'? TypeAnn
TMod = 'readonly' | '+' | '-'
"""

_PY = r"""
File ~; List
List = ( Stmt | 'NL' )*
Simple = Small ( ';' Small )* ';'? 'NL'
Suite = ':' I:File | ':' Simple
Stmt = Simple | 'if' Named Suite ( 'elif' Named Suite )* Else? | 'while' Named Suite Else? | 'async'? 'for' Targets 'in' Stars Suite Else?
Stmt = 'try' Suite ( ( 'except' ( Test ( 'as' Id )? )? Suite )+ Else? Finally? | ( 'except' '*' Test ( 'as' Id )? Suite )+ Else? Finally? | Finally )
Stmt = 'async'? 'with' WithItem ( ',' WithItem )* Suite | 'async'? 'with' P:WithItems Suite
Stmt = Decorator* 'class' Id TypeParams P:Args? Suite | Decorator* 'async'? 'def' Id TypeParams P:Params ( '->' Test )? Suite
Stmt = 'match' Stars ':' I:CaseBlock
CaseBlock = ( 'case' Patterns ( 'if' Named )? Suite | 'NL' )+
Patterns = Patt ( ',' Patt )* ','?
Patt = OrPatt ( 'as' Id )? | '*' Id
OrPatt = PattAtom ( '|' PattAtom )*
PattAtom = '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | 'None' | 'True' | 'False' | Dotted P:PattArgs? | P:PattList | S:PattList | B:PattDict
PattList = Patterns?
PattArgs ~, PattArg
PattArg = Patt | Id '=' Patt
PattDict ~, PattEntry
PattEntry = PattAtom ':' Patt | '**' Id
Else = 'else' Suite
Finally = 'finally' Suite
WithItems ~, WithItem
WithItem = Test ( 'as' Target )?
Decorator = '@' Named 'NL'
TypeParams = S:TParams?
TParams ~, TParam
TParam = '*'? Id ( ':' Test )? ( '=' Test )? | '**' Id ( '=' Test )?
Small = Stars | Targets AugOp Value | ( Targets '=' )+ Value | Target ':' Test ( '=' Value )? | 'del' Targets | 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' ( Test ( 'from' Test )? )?
Small = 'global' Id ( ',' Id )* | 'nonlocal' Id ( ',' Id )* | 'assert' Test ( ',' Test )? | 'import' AsName ( ',' AsName )* | 'from' From 'import' ( '*' | ImportName ( ',' ImportName )* | P:ImportNames ) | 'type' Id TypeParams '=' Test
From = ( '.' | '...' )* Dotted | ( '.' | '...' )+
AsName = Dotted ( 'as' Id )?
ImportNames = ImportName ( ',' ImportName )* ','?
ImportName = Id ( 'as' Id )?
Dotted = Id ( '.' Id )*
Value = Stars | 'yield' 'from' Test | 'yield' Stars?
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**='
Targets = TStar ( ',' TStar )* ','?
TStar = '*'? Target
Target = Power | P:TargetList | S:TargetList
TargetList = Targets?
Stars = Star ( ',' Star )* ','? | 'yield' 'from' Test | 'yield' Stars?
Star = Named | '*' OrExpr
Named = Test | Id ':=' Test
Test = OrTest | OrTest 'if' OrTest 'else' Test | 'lambda' LambdaParams? ':' Test
LambdaParams = LParam ( ',' LParam )* ','?
LParam = Id ( '=' Test )? | '*' Id? | '**' Id | '/'
OrTest = NotTest ( ( 'and' | 'or' ) NotTest )*
NotTest = 'not'* Cmp
Cmp = OrExpr ( CmpOp OrExpr )*
CmpOp = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
OrExpr = Fac ( BinOp Fac )*
BinOp = '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'
Fac = ( '+' | '-' | '~' )* 'await'? Power
Power = Atom Trailer*
Trailer = P:Args | S:Subs | '.' Id
Atom = Id | NUM | STR+ | 'None' | 'True' | 'False' | '...' | P:ParenBody | S:ListBody | B:BraceBody
ParenBody = Stars? | Named Comp | Value
ListBody = Stars? | Named Comp
BraceBody = ( Entry ( ',' Entry )* ','? )? | Test ':' Test Comp | Stars | Named Comp
Entry = Test ':' Test | '**' OrExpr
Comp = ( 'async'? 'for' Targets 'in' OrTest ( 'if' CompIf )* )+
CompIf = OrTest | Id ':=' OrTest
Args ~, Arg
Arg = Named | Test Comp | Named Comp | Id '=' Test | '*' Test | '**' Test
Subs ~, Sub
Sub = Named | '*' OrExpr | Test? ':' Test? ( ':' Test? )?
Params ~, Param
Param = Id ( ':' Test )? ( '=' Test )? | '*' ( Id ( ':' ( Test | '*' OrExpr ) )? )? | '**' Id ( ':' Test )? | '/'
Id = ID | 'match' | 'case' | 'type'
Field = Stars
"""

_JSON = r"""
Value = STR | NUM | 'true' | 'false' | 'null' | B:Members | S:Values
Members ~! Member
Member = STR ':' Value
Values ~! Value
"""

_JAVA = r"""
File ~; Tops
Tops = ( Package | Import | TypeDecl | ';' )*
Package = Anno* 'package' QName ';'
Import = 'import' 'static'? QName ( '.' '*' )? ';'
TypeDecl = Mods ( Class | Interface | Enum | Record | AnnoType )
Mods = ( Mod | Anno )*
Mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
Anno = '@' QName P:AnnoArgs?
AnnoArgs ~, AnnoArg
AnnoArg = ( Id '=' )? AnnoValue
AnnoValue = Cond | Anno | B:AnnoValues
AnnoValues ~, AnnoValue
Class = 'class' Id TParams? ( 'extends' Type )? ( 'implements' Types )? ( 'permits' Types )? B:ClassBody
Interface = 'interface' Id TParams? ( 'extends' Types )? ( 'permits' Types )? B:ClassBody
Record = 'record' Id TParams? P:Params ( 'implements' Types )? B:ClassBody
Enum = 'enum' Id ( 'implements' Types )? B:EnumBody
AnnoType = '@' 'interface' Id B:ClassBody
EnumBody = ( EnumConst ( ',' EnumConst )* )? ','? ( ';' Members )?
EnumConst = Anno* Id P:Args? B:ClassBody?
ClassBody ~; Members
Members = ( Member | ';' )*
Member = TypeDecl | 'static'? B:Block | Mods TParams? ( Type | 'void' ) Id P:Params Dims ( 'throws' Types )? ( B:Block | 'default' AnnoValue ';' | ';' ) | Mods TParams? Id P:Params ( 'throws' Types )? B:Block | Mods Id B:Block | Mods Type Vars ';'
Vars = Var ( ',' Var )*
Var = Id Dims ( '=' VarInit )?
VarInit = Expr | B:Inits
Inits ~, VarInit
Dims = S:Empty*
Empty =
Params ~! Param
Param = Mods Type ( Anno* '...' )? Id Dims | Mods Type ( Id '.' )? 'this'
Types = Type ( ',' Type )*
Type = Anno* TName ( Anno* S:Empty )*
TName = Prim | Id TArgs? ( '.' Anno* Id TArgs? )*
Prim = 'int' | 'long' | 'double' | 'float' | 'boolean' | 'char' | 'byte' | 'short'
TArgs = '<' ( TArg ( ',' TArg )* )? '>'
TArg = Type | Anno* '?' ( ( 'extends' | 'super' ) Type )?
TParams = '<' TParam ( ',' TParam )* '>'
TParam = Anno* Id ( 'extends' Type ( '&' Type )* )?
QName = Id ( '.' Id )*
Block ~; Stmts
Stmts = Stmt*
Stmt = ';' | B:Block | LocalVar ';' | Mods ( Class | Interface | Enum | Record ) | ExprStmt ';' | Id ':' Stmt | 'if' P:Expr Stmt ( 'else' Stmt )? | 'while' P:Expr Stmt | 'do' Stmt 'while' P:Expr ';' | 'for' P:ForHead Stmt
Stmt = 'switch' P:Expr B:SwitchBody | 'try' P:Resources? B:Block ( 'catch' P:CatchParam B:Block )* ( 'finally' B:Block )? | 'return' Expr? ';' | 'throw' Expr ';' | 'break' Id? ';' | 'continue' Id? ';' | 'yield' Expr ';' | 'assert' Expr ( ':' Expr )? ';' | 'synchronized' P:Expr B:Block
LocalVar = ( 'final' | Anno )* Type Vars
ForHead = ( LocalVar | Exprs )? ';' Expr? ';' Exprs? | ( 'final' | Anno )* Type Id ':' Expr
Exprs = Expr ( ',' Expr )*
Resources = Resource ( ';' Resource )* ';'?
Resource = ( 'final' | Anno )* Type Id '=' Expr | Call
CatchParam = ( 'final' | Anno )* Type ( '|' Type )* Id
SwitchBody = ( SwitchLabel ( ':' Stmts | '->' ( Expr ';' | B:Block | 'throw' Expr ';' ) ) )*
SwitchLabel = 'case' CaseItem ( ',' CaseItem )* ( 'when' Expr )? | 'default'
CaseItem = Cond | 'default' | Type Id | RecPatt
RecPatt = Type P:Patts Id?
Patts ~! Patt
Patt = Type Id | RecPatt
ExprStmt = Call ( '++' | '--' )? | ( '++' | '--' ) Unary | Call AssignOp Expr
Expr = Cond | Lambda | Call AssignOp Expr
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '>' '>' '>' '='
Lambda = ( Id | P:LambdaParams ) '->' ( Expr | B:Block )
LambdaParams ~! LambdaParam
LambdaParam = Id | Param
Cond = Bin ( '?' Expr ':' ( Cond | Lambda ) )?
Bin = Unary ( BinOp Unary | 'instanceof' 'final'? ( Type Id? | RecPatt ) )*
BinOp = '+' | '-' | '*' | '/' | '%' | '<' | '<=' | '>' | '>' '=' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||' | '<<' | '>' '>' | '>' '>' '>'
Unary = UnOp* Postfix
UnOp = '!' | '~' | '+' | '-' | '++' | '--' | P:CastType
CastType = Type ( '&' Type )*
Postfix = Call ( '++' | '--' )? | Lambda | 'switch' P:Expr B:SwitchBody
Call = Primary Suffix*
Suffix = '.' TArgs? Id P:Args? | '.' 'class' | '.' 'this' | '.' 'super' | '.' 'new' New | S:Expr | '::' TArgs? ( Id | 'new' )
Primary = Id P:Args? | NUM | STR | 'this' P:Args? | 'super' P:Args? | 'null' | 'true' | 'false' | P:Expr | 'new' New | Prim Dims '.' 'class' | 'void' '.' 'class' | Type '::' ( Id | 'new' ) | TName S:Empty+ '.' 'class'
New = Anno* TName ( P:Args B:ClassBody? | S:Expr+ Dims | S:Empty+ B:Inits )
Args ~! Expr
Id = ID | 'record' | 'sealed' | 'permits' | 'yield' | 'when' | 'non'
"""

_GO = r"""
File ~; Tops
Tops = ( Top | End )*
End = ';' | 'NL'
Top = 'package' ID End | 'import' ImportSpec End | 'import' P:ImportSpecs End | Decl End | 'func' P:Params? ID TypeParams? Sig B:Block? End
ImportSpecs ~; ImportList
ImportList = ( ImportSpec End | End )*
ImportSpec = ( ID | '.' )? STR
Decl = 'const' Const | 'const' P:Consts | 'var' Var | 'var' P:Vars | 'type' TypeSpec | 'type' P:TypeSpecs
Consts ~; ConstList
ConstList = ( Const End | End )*
Const = Ids ( Type? '=' Exprs )?
Vars ~; VarList
VarList = ( Var End | End )*
Var = Ids Type ( '=' Exprs )? | Ids '=' Exprs
TypeSpecs ~; TypeList
TypeList = ( TypeSpec End | End )*
TypeSpec = ID TypeParams? '='? Type
TypeParams = S:TParams
TParams ~, TParam
TParam = ID Constraint?
Constraint = '~'? Type ( '|' '~'? Type )*
Ids = ID ( ',' ID )*
Exprs = Expr ( ',' Expr )*
Sig = P:Params ( Type | P:Params )?
Params ~, Param
Param = '...'? Type | ID '...'? Type
Type = ID ( '.' ID )? TypeArgs? | '*' Type | S:Expr Type | S:Empty Type | S:Dots Type | 'map' S:Type Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Sig | 'struct' B:Fields | 'interface' B:Methods | P:Type
TypeArgs = S:Types
Types ~, Type
Empty =
Dots = '...'
Fields ~; FieldList
FieldList = ( Field End | End )*
Field = Ids Type STR? | '*'? ID ( '.' ID )? TypeArgs? STR?
Methods ~; MethodList
MethodList = ( ID Sig End | Constraint End | End )*
Block ~; Stmts
Stmts = ( Stmt End | End )*
Stmt = Simple | Decl | B:Block | If | 'for' B:Block | 'for' ForHead B:Block | Switch | 'select' B:Comms | 'go' Expr | 'defer' Expr | 'return' Exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | ID ':' 'NL'* Stmt?
Simple = Expr | Exprs AssignOp Exprs | Expr '++' | Expr '--' | Expr '<-' Expr
AssignOp = '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '&' '^='
If = 'if' ( Simple? ';' )? Expr B:Block ( 'else' ( If | B:Block ) )?
ForHead = Expr | Simple? ';' Expr? ';' Simple? | ( Exprs ( ':=' | '=' ) )? 'range' Expr
Switch = 'switch' ( Simple? ';' )? ( Expr | ID ':=' Expr | Simple )? B:Cases
Cases = End* ( ( 'case' CaseItems | 'default' ) ':' Stmts )*
CaseItems = CaseItem ( ',' CaseItem )*
CaseItem = Expr | Type
Comms = End* ( ( 'case' Simple | 'default' ) ':' Stmts )*
Expr = Unary ( BinOp Unary )*
BinOp = '+' | '-' | '*' | '/' | '%' | '<' | '<=' | '>' | '>' '=' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||' | '<<' | '>' '>' | '&' '^'
Unary = UnOp* Operand Suffix*
UnOp = '+' | '-' | '!' | '^' | '*' | '&' | '<-'
Operand = ID | NUM | STR | P:Expr | 'func' Sig B:Block | Type B:Elements | P:Type | Type P:Args
Suffix = '.' ID | '.' P:Type | '.' P:TypeWord | S:Index | P:Args | B:Elements
TypeWord = 'type'
Index = Expr ( ',' Expr )* | Type ( ',' Type )* | Expr? ':' Expr? ( ':' Expr )?
Args ~, Arg
Arg = Expr '...'? | Type
Elements ~, Element
Element = ( ElementValue ':' )? ElementValue
ElementValue = Expr | B:Elements
"""

_RS = r"""
File ~; Items
Items = ( Item | ';' )*
Item = Attr* Vis? ( Fn | Struct | Enum | Union | Impl | Trait | Use | Mod | Const | Static | TypeAlias | Extern | MacroRules ) | Attr* MacroItem | InnerAttr
InnerAttr = '#' '!' S:Tree
Attr = '#' S:Tree
Vis = 'pub' P:VisIn?
VisIn = 'crate' | 'super' | 'self' | 'in' Path
Tree = ( TOKEN | P:Tree | S:Tree | B:Tree )*
Fn = FnQual* 'fn' ID Generics? P:Params ( '->' Type )? Where? ( B:Block | ';' )
FnQual = 'const' | 'async' | 'unsafe' | 'extern' STR?
Params ~, Param
Param = Attr* ( SelfParam | Pattern ':' Type | '...' | Type )
SelfParam = ( '&' LIFE? )? 'mut'? 'self' ( ':' Type )?
Struct = 'struct' ID Generics? ( Where? B:Fields | P:TupleFields Where? ';' | ';' )
Union = 'union' ID Generics? Where? B:Fields
Fields ~, Field
Field = Attr* Vis? ID ':' Type
TupleFields ~, TupleField
TupleField = Attr* Vis? Type
Enum = 'enum' ID Generics? Where? B:Variants
Variants ~, Variant
Variant = Attr* Vis? ID ( P:TupleFields | B:Fields )? ( '=' Expr )?
Impl = 'unsafe'? 'impl' Generics? ( '!'? Type 'for' )? Type Where? B:File
Trait = 'unsafe'? 'auto'? 'trait' ID Generics? ( ':' Bounds )? Where? B:File
Use = 'use' UseTree ';'
UseTree = '::'? UseSeg ( '::' UseSeg )* ( 'as' ( ID | '_' ) )? | ( '::'? UseSeg ( '::' UseSeg )* )? '::'? ( '*' | B:UseTrees )
UseTrees ~, UseTree
UseSeg = ID | 'self' | 'super' | 'crate'
Mod = 'unsafe'? 'mod' ID ( ';' | B:File )
Const = 'const' ( ID | '_' ) ( ':' Type )? ( '=' Expr )? ';'
Static = 'static' 'mut'? ID ':' Type ( '=' Expr )? ';'
TypeAlias = 'type' ID Generics? ( ':' Bounds )? Where? ( '=' Type )? Where? ';'
Extern = 'extern' 'crate' ( ID | 'self' ) ( 'as' ( ID | '_' ) )? ';' | 'unsafe'? 'extern' STR? B:File
MacroRules = 'macro_rules' '!' ID ( B:Tree | P:Tree ';' | S:Tree ';' )
MacroItem = Path '!' ID? ( B:Tree | P:Tree ';' | S:Tree ';' )
Generics = '<' ( GParam ( ',' GParam )* ','? )? '>'
GParam = Attr* ( LIFE ( ':' Bounds? )? | 'const' ID ':' Type ( '=' Expr1 )? | ID ( ':' Bounds? )? ( '=' Type )? )
Where = 'where' ( WherePred ( ',' WherePred )* ','? )?
WherePred = LIFE ':' Bounds? | ForLife? Type ':' Bounds?
ForLife = 'for' Generics
Bounds = Bound ( '+' Bound )* '+'?
Bound = LIFE | '?'? ForLife? Path | P:Bound | '~' 'const' Path
Type = TypeNoPlus | 'dyn' Bounds | 'impl' Bounds | TypeNoPlus '+' Bounds
TypeNoPlus = Path | QPath | '&' LIFE? 'mut'? TypeNoPlus | '&&' LIFE? 'mut'? TypeNoPlus | '*' ( 'const' | 'mut' ) TypeNoPlus | P:Types | S:ArrayType | '!' | '_' | ForLife? FnQual* 'fn' P:FnTypeParams ( '->' TypeNoPlus )? | 'dyn' Bound | 'impl' Bound | Path '!' P:Tree
Types ~, Type
ArrayType = Type ( ';' Expr )?
FnTypeParams ~, FnTypeParam
FnTypeParam = Attr* ( ( ID | '_' ) ':' )? Type | '...'
Path = '::'? Seg ( '::' Seg )*
Seg = ( ID | 'self' | 'Self' | 'super' | 'crate' ) ( '::'? GArgs | P:Types ( '->' TypeNoPlus )? )?
GArgs = '<' ( GArg ( ',' GArg )* ','? )? '>'
GArg = Type | LIFE | '-'? NUM | STR | 'true' | 'false' | B:Block | ID GArgs? ( '=' Type | ':' Bounds )
QPath = '<' Type ( 'as' Path )? '>' ( '::' Seg )+
Block ~; Stmts
Stmts = ( Stmt | ';' | InnerAttr )* Expr?
Stmt = Item | Attr* 'let' Pattern ( ':' Type )? ( '=' Expr ( 'else' B:Block )? )? ';' | Attr* Expr ';' | Attr* BlockLike
BlockLike = ( Label ':' )? ( B:Block | 'unsafe' B:Block | 'async' 'move'? B:Block | 'const' B:Block | If | 'loop' B:Block | 'while' Cond B:Block | 'for' Pattern 'in' ExprNS B:Block | 'match' ExprNS B:Arms ) | Path '!' B:Tree
Label = LIFE
If = 'if' Cond B:Block ( 'else' ( If | B:Block ) )?
Cond = ExprNS | LetCond ( '&&' ( ExprNS | LetCond ) )*
LetCond = 'let' Pattern '=' ExprNS
Arms = InnerAttr* ( Arm ( ',' | ) )*
Arm = Attr* Pattern ( 'if' Cond )? '=>' Expr
Pattern = '|'? Pat1 ( '|' Pat1 )*
Pat1 = Attr* ( ( 'ref' )? 'mut'? ID ( '@' Pat1 )? | '_' | '..' | Lit | RangeEnd? RangeOp RangeEnd? | PathX | PathX P:Patterns | PathX B:FieldPats | P:Patterns | S:Patterns | ( '&' | '&&' ) 'mut'? Pat1 | Path '!' P:Tree | 'box' Pat1 | 'const' B:Block )
RangeOp = '..=' | '..' | '...'
RangeEnd = Lit | PathX
PathX = Path | QPath
Lit = '-'? NUM | STR | 'true' | 'false'
Patterns ~, Pattern
FieldPats ~, FieldPat
FieldPat = Attr* ( ( ID | NUM ) ':' Pattern | 'ref'? 'mut'? ID | '..' )
Expr = Jump | Closure | Range | Unary AssignOp Expr
ExprNS = Jump | Closure | Range | Unary AssignOp Expr
Expr1 = Lit | B:Block | Path
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '='
Jump = 'return' Expr? | 'break' LIFE? Expr? | 'continue' LIFE?
Closure = ForLife? 'static'? 'async'? 'move'? ( '||' | '|' ( ClosureParam ( ',' ClosureParam )* ','? )? '|' ) ( '->' TypeNoPlus B:Block | Expr )
ClosureParam = Attr* Pat1 ( ':' Type )?
Range = Bin | Bin? ( '..' | '..=' ) Bin?
Bin = Unary ( BinOp ( Unary | Closure | Jump ) | 'as' TypeNoPlus )*
BinOp = '+' | '-' | '*' | '/' | '%' | '<' | '<=' | '>' | '>' '=' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||' | '<<' | '>' '>'
Unary = UnOp* Primary Suffix*
UnOp = '-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ( 'const' | 'mut' )
Suffix = '.' ( ID | 'await' ) ( '::' GArgs )? | '.' NUM | P:Args | S:Expr | '?'
Primary = Lit | STR | PathX | PathX B:FieldExprs | P:Args | S:ArrayExpr | BlockLike | Path '!' ( P:Tree | S:Tree | B:Tree ) | '_'
Args ~, Arg
Arg = Attr* Expr
ArrayExpr = ( Expr ( ',' Expr )* ','? )? | Expr ';' Expr
FieldExprs ~, FieldExpr
FieldExpr = Attr* ( ( ID | NUM ) ':' Expr | ID | '..' Expr | '..' )
"""

_words = lambda s: frozenset(s.split())

#: Reserved words of each language (as ECMAScript modules, Python 3.13, Rust 2021, ...).
KEYWORDS = {
    "js": _words(
        "break case catch class const continue debugger default delete do else enum export extends false finally for function if "
        "import in instanceof new null return super switch this throw true try typeof var void while with yield await let static "
        "implements interface package private protected public async get set of from as accessor"
    ),
    "py": _words(
        "False None True and as assert async await break class continue def del elif else except finally for from global if import "
        "in is lambda nonlocal not or pass raise return try while with yield match case type"
    ),
    "json": _words("true false null"),
    "java": _words(
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally "
        "float for goto if implements import instanceof int interface long native new package private protected public return short "
        "static strictfp super switch synchronized this throw throws transient try void volatile while true false null _ record "
        "sealed permits yield when non"
    ),
    "go": _words(
        "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return "
        "select struct switch type var"
    ),
    "rs": _words(
        "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref "
        "return self Self static struct super trait true type unsafe use where while abstract become box do final macro override priv "
        "typeof unsized virtual yield try _ macro_rules union auto raw"
    ),
}
KEYWORDS["ts"] = KEYWORDS["js"] | _words(
    "type declare abstract readonly namespace module keyof infer is asserts unique override satisfies global"
)
#: Words that are reserved only in some places: they stand for names as well.
CONTEXTUAL = {
    "rs": _words("macro_rules union auto raw box"),
}

TEXTS = {"js": _JS + _PLAIN, "ts": _JS + _TS, "py": _PY, "json": _JSON, "java": _JAVA, "go": _GO, "rs": _RS}
START = {"js": "Stmts", "ts": "Stmts", "py": "File", "json": "Value", "java": "File", "go": "File", "rs": "File"}
