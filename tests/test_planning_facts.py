from pyspark.sql import functions as F

from grovespark.operators import algorithms as G
from grovespark.operators import channels as H
from grovespark.operators import facts as A
from grovespark.operators import planning as P
from grovespark.operators import traversal as T


def test_bindings_and_interfaces_against_a_target(spark):
    exports = spark.createDataFrame([("app/cart/Cart.ets", "Cart"), ("app/cart/Pay.ets", "PayImpl"), ("lib/x.ets", "helper"), ("lib/y.ets", None)], "file string, name string")
    b = spark.createDataFrame([("cart", "CartImpl"), ("Pay", "PayImpl"), ("Cart", "payimpl")], "iface string, impl string")
    assert {(r.iface, r.impl): r.missing_ends for r in P.binding_gaps(b, exports).collect()} == {("cart", "CartImpl"): ["CartImpl"], ("Pay", "PayImpl"): ["Pay"], ("Cart", "payimpl"): []}
    members = spark.createDataFrame([("Cart", "cart"), ("Cart", "Lost"), ("Cart", "Old"), ("Other", "helper"), ("Other", "none"), ("Under", "helper"), ("Under", "Cart")], "module string, name string")
    renames = spark.createDataFrame([("Cart", "old", "PayImpl")], "module string, name string, new_name string")
    where = spark.createDataFrame([("Under", "lib/")], "module string, prefix string")
    got = {r.module: (r.scope, r.source_count, r.matched_count, r.missing) for r in P.interface_fidelity(members, exports, renames, where).collect()}
    assert got == {"Cart": ("module-path", 3, 2, ["Lost"]), "Other": ("global", 2, 1, ["none"]), "Under": ("ledger-paths", 2, 1, ["Cart"])}
    assert [r.file for r in P.scoped_exports(exports, ["lib"]).collect()] == ["lib/x.ets", "lib/y.ets"] and P.scoped_exports(exports, names_=["Cart!"]).count() == 2


def test_interfaces_cut_paths_only_where_a_name_begins(spark):
    texts, keys = ["srccartcartitem", "cartographer", "ab", "xcartographerlonga", ""], ["cart", "cartographer", "cartographerlong", "a", "ab", "itemsofacart"]
    made = lambda c, x: spark.createDataFrame([(i,) for i in x], f"{c} string")
    members = made("module", keys).select("module", "module").toDF("module", "name")
    none = spark.createDataFrame([], "module string, name string, new_name string, prefix string")
    out = P.interface_fidelity(members, made("file", texts).select("file", F.lit("Cart").alias("name")), none.select("module", "name", "new_name"), none.select("module", "prefix"))
    assert {r.module: r.scope for r in out.collect()} == {k: "module-path" if any(k in t for t in texts) else "global" for k in keys}
    assert out._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange") < 30  # tables used often are computed once
    assert {(r["_k"], r["_s"]) for r in P._holding(made("_s", texts), made("_k", keys)).collect()} == {(k, t) for k in keys for t in texts if k in t}


def test_literals_and_collisions(spark):
    f = spark.createDataFrame([("a", "SELECT *\n  FROM t"), ("b", "x = 'PAID'"), ("c", None)], "path string, content string")
    assert {r.literal: (r.n_files, r.first_file) for r in P.literal_hits(f, ["'PAID'", "'DUE'"]).collect()} == {"'PAID'": (1, "b"), "'DUE'": (0, None)}
    assert P.literal_hits(f, ["select * from T"], sql=True).first().n_files == 1
    c = spark.createDataFrame([("A",), ("a",), ("b",)], "subject string")
    assert [(r["name"], r["n"]) for r in P.name_collisions(c).collect()] == [("a", 2)]
    s = lambda *x: spark.createDataFrame(list(x), "g string, m string")
    assert {r.g: r.same for r in P.same_members(s(("1", "a"), ("1", "b"), ("2", "a")), s(("1", "b"), ("1", "a"), ("2", "c"), ("3", "x")), "g", "m").collect()} == {"1": True, "2": False, "3": False}


def test_units(spark):
    units = spark.createDataFrame([("app", 5), ("core", 9), ("a", 2), ("b", 3), ("x", 1), ("y", 4)], "unit string, size int")
    deps = spark.createDataFrame([("app", "a"), ("app", "b"), ("a", "core"), ("b", "core"), ("x", "y"), ("y", "x")], "a string, b string")
    got = {r.unit: (r.place, r.wave) for r in P.order_units(units, deps).collect()}
    assert got == {"core": (0, 0), "y": (1, 0), "x": (2, 0), "b": (3, 1), "a": (4, 1), "app": (5, 2)}
    merged = {r.unit: r.merged for r in P.merge_to_fixpoint(units.where("unit not in ('x', 'y')"), deps.where("a not in ('x', 'y')"), 4, 100).collect()}
    assert merged == {"app": "app", "core": "core", "a": "b", "b": "b"}
    m = spark.createDataFrame([("u1", "a"), ("u2", "b"), ("u3", "core")], "unit string, module string")
    assert {(r.a, r.b) for r in P.unit_dependencies(m, deps).collect()} == {("u1", "u3"), ("u2", "u3")}
    files = spark.createDataFrame([("u", "f1", "p"), ("u", "f2", "q"), ("u", "f3", None), ("v", "g", "p")], "unit string, file string, feature string")
    assert {(r.unit, r.slice, r.file) for r in P.split_by_feature(files).collect()} == {("u", "p", "f1"), ("u", "q", "f2"), ("u", "", "f3"), ("v", "", "g")}
    assert {r.module: r.feature for r in P.dominant_feature(files.select(F.col("unit").alias("module"), "feature", "file")).collect()} == {"u": "p", "v": "p"}
    facts = spark.createDataFrame([("m", "api", f"s{i}", "d") for i in range(5)], "module string, facet string, subject string, detail string")
    assert [(r.subject, r.n_facet) for r in P.module_briefs(facts, 2).orderBy("place").collect()] == [("s0", 5), ("s1", 5)]
    u = spark.createDataFrame([("id1", 0, "Base", "core"), ("id2", 1, "id1", "app")], "unit string, place int, label string, module string")
    assert [P.find_unit(u, q).collect()[0].unit for q in ("1", "ID1", "base", "app")] == ["id2", "id1", "id1", "id2"] and P.find_unit(u, "none").count() == 0
    assert P.unit_tokens(7) == 210


def test_flows_families_and_walks(spark):
    e = spark.createDataFrame([("a", "x", "calls"), ("x", "b", "calls"), ("b", "y", "calls"), ("y", "z", "calls"), ("z", "c", "calls"), ("b", "a", "calls")], "source string, target string, kind string")
    named = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [(r.path, r.n_named) for r in T.named_flow(named, e).collect()][0] == ("b > a", 2)
    assert ("b > y > z > c", 2) in [(r.path, r.n_named) for r in T.named_flow(named, e, bridge=2, best=9).collect()] and T.named_flow(named.where("false"), e).count() == 0
    n = spark.createDataFrame([(f"m{i}", "method", "go", f"f::C{i}.go", "java") for i in range(9)] + [(f"c{i}", "class", f"C{i}", f"f::C{i}", "java") for i in range(9)] + [("i", "interface", "Go", "f::Go", "java")], "id string, kind string, name string, qualified_name string, language string")
    up = spark.createDataFrame([(f"c{i}", "i", "implements") for i in range(9)], "source string, target string, kind string")
    assert [(r["name"], r.supertype, r.n_members, r.n_classes) for r in T.polymorphic_families(n, up).collect()] == [("go", "Go", 9, 9)] and T.polymorphic_families(n, up, 10).count() == 0
    ids = spark.createDataFrame([(x, "function") for x in "abcxyz"], "id string, kind string")
    walk = T.depth_first(spark.createDataFrame([("a",)], "seed string"), ids, e).orderBy("place").collect()
    assert [(r.id, r.parent, r.depth) for r in walk] == [("a", None, 0), ("x", "a", 1), ("b", "x", 2), ("y", "b", 3), ("z", "y", 4), ("c", "z", 5)]
    nav = spark.createDataFrame([("S1", "h", "calls"), ("h", "S2", "calls"), ("S2", "S1", "references")], "source string, target string, kind string")
    assert {tuple(r) for r in T.lifted_navigation(nav, spark.createDataFrame([("S1",), ("S2",)], "id string")).collect()} == {("S1", "S2"), ("S2", "S1")}


def test_scattered_communities_and_hubs(spark):
    ids = [f"v{i}" for i in range(16)]
    parts = spark.createDataFrame([(i, "all") for i in ids], "id string, community string")
    links = spark.createDataFrame([(f"v{i}", f"v{i + 1}", 1) for i in range(0, 16, 2)], "a string, b string, weight int")
    mods = spark.createDataFrame([(i, f"m{k % 8}") for k, i in enumerate(ids)], "id string, module string")
    got = {r.id: r.community for r in G.split_scattered(parts, links, mods).collect()}
    assert len(set(got.values())) == 8 and all(got[f"v{i}"] == got[f"v{i + 1}"] for i in range(0, 16, 2))
    assert G.split_scattered(parts, links, mods.withColumn("module", F.lit("m"))).collect() == parts.collect()
    star = spark.createDataFrame([("v1", "v0", 1), ("v1", "v2", 1), ("v3", "v2", 1)], "a string, b string, weight int")
    m = spark.createDataFrame([("v0", "a"), ("v1", "b"), ("v2", "a"), ("v3", "a")], "id string, module string")
    assert [(r.hub, r.primary_module) for r in G.hubs(parts.where("id in ('v0', 'v1', 'v2', 'v3')"), star, m).collect()] == [("v2", "a")]


SAMPLES = {
    "event-emitter": ("typescript", "bus.on('user:new', (u) => save(u));", "bus.emit('user:new', u);"),
    "celery-dispatch": ("python", "@shared_task\ndef send_mail(x):\n    pass\n", "send_mail.delay(1)"),
    "sidekiq-dispatch": ("ruby", "class MailJob < Base\n  include Sidekiq::Worker\n", "MailJob.perform_async(1)"),
    "laravel-event": ("php", "public function handle(OrderPaid $event) {}", "event(new OrderPaid($o));"),
    "spring-event": ("java", "@EventListener\n  public void on(OrderPaid e) {}", "bus.publishEvent(new OrderPaid(1));"),
    "mediatr-dispatch": ("csharp", "class H : IRequestHandler<GetUser, User> {}", "await m.Send(new GetUser(1));"),
    "redux-thunk": ("typescript", "export const loadUser = createAsyncThunk('u', f);", "dispatch(loadUser(1));"),
    "rtk-query": ("typescript", "endpoints: (b) => ({ getUser: build.query({}) })", "const { data } = useGetUserQuery(1);"),
    "vuex-dispatch": ("javascript", "async loadCart({ commit }, id) {}", "this.$store.dispatch('cart/loadCart', 1)"),
    "pinia-store": ("typescript", "export const useCartStore = defineStore('cart', {});", "const s = useCartStore();"),
    "compose-route": ("kotlin", 'composable("home") { HomeScreen() }', 'nav.navigate("home")'),
    "android-intent": ("kotlin", "class DetailActivity : AppCompatActivity() {}", "startActivity(Intent(this, DetailActivity::class.java))"),
    "android-fragment": ("java", "public class ListFragment extends Fragment {}", "tx.replace(R.id.x, new ListFragment());"),
    "arkui-route": ("arkts", "@Entry\n@Component\nstruct Detail {}", "router.pushUrl({ url: 'pages/Detail' })"),
    "arkui-emitter": ("arkts", "emitter.on({ eventId: 7 }, f)", "emitter.emit({ eventId: 7 })"),
    "rn-event-channel": ("javascript", "sub.addListener('onScan', f)", 'self.emit("onScan")'),
    "gin-route": ("go", "func ListUsers(c *gin.Context) {}", 'r.GET("/users", ListUsers)'),
    "request-handler": ("go", "func (c *C) Show(ctx context.Context, req *v1.ShowReq) {}", "type ShowReq struct { g.Meta }"),
    "field-pointer": ("c", "static struct ops o = { .open_file = my_open, };", "dev->ops.open_file(dev);"),
    "state-holder": ("kotlin", "class CartViewModel : ViewModel() {}", "val vm = hiltViewModel<CartViewModel>()"),
}


def test_every_channel_rule(spark):
    assert set(SAMPLES) == set(H.RULES)
    rows = [(f"{t}:{side}", lang, code) for t, (lang, *sides) in SAMPLES.items() for side, code in zip(("on", "emit"), sides)] + [("none", "go", None)]
    code = spark.createDataFrame(rows, "id string, language string, code string")
    for tag in H.RULES:
        own = code.where(F.col("id").startswith(tag) | (F.col("id") == "none"))
        assert {(r.source, r.target) for r in H.dispatch_edges(own, [tag]).collect()} == {(f"{tag}:emit", f"{tag}:on")}, tag


def test_hot_channels_are_skipped_and_sites_found(spark):
    code = spark.createDataFrame([(f"h{i}", "typescript", "x.on('tick', f)") for i in range(7)] + [("e", "typescript", "x.emit('tick')")], "id string, language string, code string")
    assert H.dispatch_edges(code, ["event-emitter"]).count() == 0 and H.dispatch_edges(code.where("id in ('h1', 'e')"), ["event-emitter"]).count() == 1
    nodes = spark.createDataFrame([("f", "function", "a.ts", 1, 3), ("g", "function", "a.ts", 4, 9)], "id string, kind string, file_path string, start_line int, end_line int")
    f = spark.createDataFrame([("a.ts", "one\nemit('a')\n\nemit('b'); emit('c')\n")], "path string, content string")
    assert {(r.id, r.channel, r.line) for r in H.literal_sites(f, nodes, r"emit\('(\w)'\)").collect()} == {("f", "a", 2), ("g", "b", 4), ("g", "c", 4)}


def test_facts_of_texts(spark):
    f = lambda *x: spark.createDataFrame(list(x), "path string, language string, content string")
    sql = "-- t\nCREATE TABLE IF NOT EXISTS `user` (\n id INTEGER PRIMARY KEY,\n price DECIMAL(10, 2) NOT NULL,\n name TEXT,\n PRIMARY KEY (id, name)\n);\ncreate table b(x int)"
    assert [(r.table, r.column, r.type) for r in A.created_tables(f(("a", "sql", sql), ("n", "sql", None))).orderBy("table", "place").collect()] == [("b", "x", "INT"), ("user", "id", "INTEGER"), ("user", "price", "DECIMAL(10, 2)"), ("user", "name", "TEXT")]
    assert {(r["name"], r.value) for r in A.constants(f(("a", "ts", "export const MAX_SIZE: number = 10;\nconst API_URL = 'http://x';\n#define LIMIT 3\nlet small = 4;"))).collect()} == {("MAX_SIZE", "10"), ("API_URL", "'http://x'"), ("LIMIT", "3")}
    b = f(("a", "kotlin", "@Binds\nabstract fun bind(impl: CartImpl): Cart"), ("b", "csharp", "s.AddScoped<IPay, Pay>();"), ("c", "typescript", "{ provide: Log, useClass: FileLog }"), ("d", "php", "$app->bind(Mail::class, Smtp::class)"), ("e", "java", "bind(Q.class).to(QImpl.class);"))
    assert {(r.iface, r.impl) for r in A.bindings(b).collect()} == {("Cart", "CartImpl"), ("IPay", "Pay"), ("Log", "FileLog"), ("Mail", "Smtp"), ("Q", "QImpl")}
    xml = '<resources><string name="title">Hi</string><color name="c1">#fff</color></resources>'
    assert {(r.type, r["name"], r.value) for r in A.resources(f(("m/res/values/s.xml", "xml", xml), ("m/other.xml", "xml", xml))).collect()} == {("string", "title", "Hi"), ("color", "c1", "#fff")}
    nav = '<navigation><fragment android:id="@+id/home"><action app:destination="@id/detail"/></fragment><fragment android:id="@+id/detail"/></navigation>'
    assert [(r.screen, r.target) for r in A.navigation(f(("m/res/navigation/n.xml", "xml", nav))).collect()] == [("home", "detail")]
    code = spark.createDataFrame([("1", "@Composable\nfun HomeScreen() {}"), ("2", 'composable("a") {}'), ("3", "fun x() {}")], "id string, code string")
    assert {(r.id, r.screen, tuple(r.routes)) for r in A.composable_screens(code).collect()} == {("1", "HomeScreen", ()), ("2", "", ("a",))}
    p = spark.createDataFrame([("m/src/androidTest/X.kt",), ("m/src/main/X.kt",)], "p string")
    assert [r.t for r in p.select(A.is_test_set(F.col("p")).alias("t")).collect()] == [True, False]


def test_facts_of_symbols(spark):
    n = spark.createDataFrame(
        [("E", "enum", "State", "a.kt", 1, 0, None, None, None), ("x", "enum_member", "ON", "a.kt", 2, 4, None, None, None), ("y", "enum_member", "OFF", "a.kt", 2, 1, None, None, None), ("U", "class", "User", "a.kt", 5, 0, ["@Entity(x)"], None, None), ("f", "field", "name", "a.kt", 6, 0, None, "String", None), ("s", "property", "state", "a.kt", 7, 0, None, None, "val state: StateFlow<Ui>"), ("t", "function", "testX", "core/src/test/XTest.kt", 1, 0, None, None, None)],
        "id string, kind string, name string, file_path string, start_line int, start_column int, decorators array<string>, return_type string, signature string",
    )
    e = spark.createDataFrame([("E", "x", "contains"), ("E", "y", "contains"), ("U", "f", "contains")], "source string, target string, kind string")
    assert [(r.place, r.value) for r in A.enum_values(n, e).orderBy("place").collect()] == [(1, "OFF"), (2, "ON")]
    assert [(r["name"], r.field, r.type) for r in A.entities(n, e).collect()] == [("User", "name", "String")]
    assert [(r.id, r.holder, r.item) for r in A.flows(n).collect()] == [("s", "StateFlow", "Ui")]
    assert [(r.module, r.n_files, r.n_cases) for r in A.test_contract(n, spark.createDataFrame([("core",)], "folder string")).collect()] == [("core", 1, 1)]
    entries = spark.createDataFrame([("core/AndroidManifest.xml", "uses-permission", "android.permission.CAMERA"), ("x/AndroidManifest.xml", "activity", "CAMERA")], "path string, tag string, name string")
    rules = spark.createDataFrame([("camera", "media.camera")], "key string, capability string")
    assert [(r.module, r.capability) for r in A.module_capabilities(entries, rules, spark.createDataFrame([("core",), ("x",)], "folder string")).collect()] == [("core", "media.camera")]
    imp = spark.createDataFrame([("a", "androidx.navigation.compose"), ("b", "androidx.navigation.x"), ("c", "java.util")], "path string, source string")
    assert [(r.framework, r.n_files) for r in A.used_frameworks(imp, {"androidx.navigation": "navigation"}).collect()] == [("navigation", 2)]
    facts = spark.createDataFrame([("user", "entity", "3 fields"), ("USER", "role", "entity")], "name string, facet string, detail string")
    assert [(r.id, r.place, r.facet) for r in A.symbol_facts(n, facts).orderBy("place").collect()] == [("U", 1, "entity"), ("U", 2, "role")]
