"""Names that belong to a language or its standard library, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages that share the names of JavaScript's run time.
SCRIPT = ["typescript", "javascript", "tsx", "jsx", "arkts"]
#: Names that are never symbols of a project, by language.
SCRIPT_NAMES = """console window document global process Promise Array Object String Number Boolean Date Math JSON RegExp Error Map Set
setTimeout setInterval clearTimeout clearInterval fetch require module exports __dirname __filename
useState useEffect useContext useReducer useCallback useMemo useRef useLayoutEffect useImperativeHandle useDebugValue""".split()
SCRIPT_PREFIXES = ["console.", "Math.", "JSON."]
ARKTS_NAMES = ["$r", "$rawfile"]
PYTHON_NAMES = "print len range str int float list dict set tuple open input type isinstance hasattr getattr setattr super self cls None True False".split()
PYTHON_TYPES = "list dict set tuple str int float bool bytes bytearray frozenset object super".split()
PYTHON_METHODS = """append extend insert remove pop clear sort reverse copy update keys values items get add discard union intersection
difference split join strip lstrip rstrip replace lower upper startswith endswith find index count encode decode format isdigit isalpha
isalnum read write readline readlines close flush seek""".split()
GO_PACKAGES = """fmt os io net http log math sort sync time path bytes strings strconv errors context json xml csv html template regexp
reflect runtime testing flag bufio crypto encoding filepath hash mime rand signal sql syscall unicode unsafe atomic binary debug exec
heap ring scanner tar zip gzip zlib tls url user pprof trace ast build parser printer token types cgo plugin race ioutil utilruntime
utilwait utilnet""".split()
GO_NAMES = """make new len cap append copy delete close panic recover print println complex real imag error nil true false iota int int8
int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 string bool byte rune any""".split()
PASCAL_PREFIXES = "System. Winapi. Vcl. Fmx. Data. Datasnap. Soap. Xml. Web. REST. FireDAC. IBX. IdHTTP IdTCP IdSSL".split()
PASCAL_NAMES = """System SysUtils Classes Types Variants StrUtils Math DateUtils IOUtils Generics.Collections Generics.Defaults Rtti
TypInfo SyncObjs RegularExpressions SysInit Windows Messages Graphics Controls Forms Dialogs StdCtrls ExtCtrls ComCtrls Menus ActnList
WriteLn Write ReadLn Read Inc Dec Ord Chr Length SetLength High Low Assigned FreeAndNil Format IntToStr StrToInt FloatToStr StrToFloat
Trim UpperCase LowerCase Pos Copy Delete Insert Now Date Time DateToStr StrToDate Raise Exit Break Continue Abort True False nil Self
Result Create Destroy Free TObject TComponent TPersistent TInterfacedObject TList TStringList TStrings TStream TMemoryStream
TFileStream Exception EAbort EConvertError EAccessViolation IInterface IUnknown""".split()
C_NAMES = """printf fprintf sprintf snprintf scanf fscanf sscanf malloc calloc realloc free memcpy memmove memset memcmp memchr strlen
strcpy strncpy strcat strncat strcmp strncmp strstr strchr strrchr strtok strdup fopen fclose fread fwrite fgets fputs fputc fgetc feof
ferror fflush fseek ftell rewind exit abort atexit atoi atol atof strtol strtoul strtod qsort bsearch abs labs rand srand sin cos tan
sqrt pow log log10 exp ceil floor fabs time clock difftime mktime localtime gmtime strftime asctime assert errno perror remove rename
tmpfile tmpnam getenv system signal raise setjmp longjmp va_start va_end va_arg va_copy NULL EOF BUFSIZ FILENAME_MAX RAND_MAX
EXIT_SUCCESS EXIT_FAILURE size_t ptrdiff_t wchar_t intptr_t uintptr_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t
FILE stat lstat fstat open close read write pipe fork exec waitpid getpid getppid kill sleep usleep pthread_create pthread_join
pthread_mutex_lock pthread_mutex_unlock dlopen dlsym dlclose""".split()
CPP_NAMES = """cout cin cerr clog endl flush ws std nullptr true false this sizeof alignof typeid static_cast dynamic_cast
reinterpret_cast const_cast make_unique make_shared make_pair move forward swap""".split()
#: Modules and headers that are never files of a project.
NODE_MODULES = "fs path os crypto http https url util events stream child_process buffer".split()
PYTHON_MODULES = "os sys json re math datetime collections typing pathlib logging".split()
C_HEADERS = """assert complex ctype errno fenv float inttypes iso646 limits locale math setjmp signal stdalign stdarg stdatomic stdbool
stddef stdint stdio stdlib stdnoreturn string tgmath threads time uchar wchar wctype""".split()
CPP_HEADERS = """algorithm any array atomic barrier bit bitset charconv chrono codecvt compare complex concepts condition_variable
coroutine deque exception execution expected filesystem format forward_list fstream functional future generator initializer_list
iomanip ios iosfwd iostream istream iterator latch limits list locale map mdspan memory memory_resource mutex new numbers numeric
optional ostream print queue random ranges ratio regex scoped_allocator semaphore set shared_mutex source_location span spanstream
sstream stack stacktrace stdexcept stdfloat stop_token streambuf string string_view strstream syncstream system_error thread tuple
type_traits typeindex typeinfo unordered_map unordered_set utility valarray variant vector version""".split()
#: Endings tried on an import's path, in order, by language.
EXTENSIONS = {
    "typescript": [".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"],
    "arkts": [".ets", ".ts", ".d.ts", ".js", "/Index.ets", "/index.ets", "/index.ts", "/index.js"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx"],
    "tsx": [".tsx", ".ts", ".d.ts", ".js", ".jsx", "/index.tsx", "/index.ts", "/index.js"],
    "jsx": [".jsx", ".js", "/index.jsx", "/index.js"],
    "svelte": [".ts", ".js", ".svelte", ".tsx", ".jsx", "/index.ts", "/index.js", "/index.svelte"],
    "vue": [".ts", ".js", ".vue", ".tsx", ".jsx", "/index.ts", "/index.js", "/index.vue"],
    "python": [".py", "/__init__.py"], "go": [".go"], "rust": [".rs", "/mod.rs"], "java": [".java"], "c": [".h", ".c"],
    "cpp": [".h", ".hpp", ".hxx", ".cpp", ".cc", ".cxx"], "csharp": [".cs"], "php": [".php"], "ruby": [".rb"], "objc": [".h", ".m", ".mm"],
    "nix": [".nix", "/default.nix"], "lua": [".lua", "/init.lua"], "luau": [".luau", ".lua", "/init.luau", "/init.lua"],
}
#: Folders that short prefixes of a path stand for where no rule of the project says otherwise.
CONVENTIONS = [("@/", "src/"), ("~/", "src/"), ("@src/", "src/"), ("src/", "src/"), ("@app/", "app/"), ("app/", "app/")]


def is_builtin(name: Column, language: Column, declared: Column, capital_declared: Column) -> Column:
    """True for a name of the language or its library. `declared`: the project has a symbol of that name;
    `capital_declared`: one of the receiver's name with a capital. What the project declares itself is only shut out
    where the language's own always wins. Null names and languages are no built-ins."""
    head, rest = F.split_part(name, F.lit("."), F.lit(1)), F.regexp_extract(name, r"^[^.]+\.(.*)$", 1)
    dotted = name.rlike(r"^[^.]+\.")
    starts = lambda some: name.rlike("^(" + "|".join(x.replace(".", r"\.") for x in some) + ")")
    script = name.isin(SCRIPT_NAMES) | starts(SCRIPT_PREFIXES)
    python = name.isin(PYTHON_NAMES) | (dotted & (head.isin(PYTHON_TYPES) | (rest.isin(PYTHON_METHODS) & ~capital_declared))) | (name.isin(PYTHON_METHODS) & ~declared)
    go = (dotted & head.isin(GO_PACKAGES)) | name.isin(GO_NAMES)
    c = name.startswith("std::") | (name.isin(C_NAMES + CPP_NAMES) & ~declared)
    out = F.when(language == "arkts", script | name.isin(ARKTS_NAMES)).when(language.isin(SCRIPT), script).when(language == "python", python).when(language == "go", go)
    return F.coalesce(out.when(language == "pascal", starts(PASCAL_PREFIXES) | name.isin(PASCAL_NAMES)).when(language.isin("c", "cpp"), c), F.lit(False))


def is_external(specifier: Column, language: Column, local_prefixes: list[str] = (), go_module: str | None = None) -> Column:
    """True for an import of a package or library outside of the project; relative ones, and those that start with one of
    the project's own prefixes (aliases, workspace packages), never are."""
    local = specifier.startswith(".")
    for p in local_prefixes:
        local = local | specifier.startswith(p)
    script = specifier.isin(NODE_MODULES) | ~specifier.rlike("^(@/|~/|src/)")
    inside = specifier.contains("/internal/")
    if go_module:
        inside = inside | (specifier == go_module) | specifier.startswith(f"{go_module}/")
    bare = F.regexp_replace(specifier, r"\.h$", "")
    headers = [f"{h}.h" for h in C_HEADERS] + [f"c{h}" for h in C_HEADERS if h not in ("stdatomic", "stdnoreturn", "threads")] + CPP_HEADERS
    c = specifier.isin(headers) | bare.isin(headers)
    out = F.when(local, False).when(language.isin(SCRIPT), script).when(language == "python", F.split_part(specifier, F.lit("."), F.lit(1)).isin(PYTHON_MODULES))
    return F.coalesce(out.when(language == "go", ~inside).when(language.isin("c", "cpp"), c), F.lit(False))
