"""Questions routed over the product registry by rules, without a model: decoding of codes, lists, scopes.

Products named in a question are found by joins on tokens; the rules are one chain of conditions over what was found, so that a table of questions is
routed as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import tokens
from quarrystone.functions.wording import asks
from quarrystone.operators import naming, registry
from quarrystone.operators.settings import picked_field

#: Words of a question that ask for one field of an option's description, tried in this order.
FIELDS = {"resolution": "Resolution", "minimum detection limit": "MDL", "detection limit": "MDL", "mdl": "MDL", "accuracy": "Accuracy", "span": "Span", "start": "Start"}
#: Vocabulary of the typed facts and abbreviations of technologies.
VOCABULARY = {"product_type": registry.TYPES, "install_type": registry.INSTALLS, "technology": registry.TECHNOLOGIES}
#: Wordings of the answers that are given at once.
FAMILY, MATCH, NOTHING, EVERYTHING = ' product(s) in the "', " product(s) match ", "No approved products are documented with ", "the approved catalog"
#: The rules in their order, and whether they answer at once or narrow the search.
RULES = {"decode": "direct", "one_product": "scoped", "family_list": "direct", "several_products": "scoped", "catalog": "direct", "attribute": "scoped", "whole_catalog": "scoped", "search": "search"}


def attributes(question: Column, vocabulary: dict[str, list[str]] = VOCABULARY, aliases: dict[str, str] = registry.TECHNOLOGY_ALIASES) -> Column:
    """``array<struct<field, value>>``: the filters that a question names: abbreviations as whole terms first, then vocabulary, longer terms first."""
    q = F.coalesce(F.lower(question), F.lit(""))
    said = lambda test, field, value: F.when(test, F.struct(F.lit(field).alias("field"), F.lit(value).alias("value")))
    padded = F.concat(F.lit(" "), F.regexp_replace(q, "[^a-z0-9]+", " "), F.lit(" "))
    found = [said(F.contains(padded, F.lit(f" {a.lower()} ")), "technology", aliases[a]) for a in sorted(aliases, key=lambda a: -len(a))]
    found += [said(F.contains(q, F.lit(t.lower())), field, t) for field, terms in vocabulary.items() for t in sorted(terms, key=lambda t: -len(t))]
    return F.array_distinct(F.array_compact(F.array(*found)))


def meets(products: DataFrame, filters: DataFrame) -> DataFrame:
    """``(id, product_id, product_name, source_catalogue)``: the products that meet any of the filters ``(id, field, value)``.

    Types and ways of installation are equal, a technology contains the value: one named more closely is one of its kind, too.
    """
    facts = products.select("product_id", "product_name", "source_catalogue", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("fact")) for f in VOCABULARY])).alias("x")).select("product_id", "product_name", "source_catalogue", "x.field", "x.fact")
    test = F.when(F.col("field") == "technology", F.contains(F.lower("fact"), F.lower("value"))).otherwise(F.col("fact") == F.col("value"))
    return filters.join(facts, "field").filter(test).select("id", "product_id", "product_name", "source_catalogue").distinct()


def named_products(questions: DataFrame, id_col: str, question_col: str, products: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``(id, product_id, product_name, alias)``: the products a question names, each with its longest alias.

    Products of which no alias stands in the question may come by a brand nearly written (``fuzzy``). A name that is part of a longer one named in the same
    question does not count. Null questions name nothing; a product without aliases has its name.
    """
    q = questions.select(F.col(id_col).alias("id"), F.col(question_col).alias("question"))
    found = naming.longest_alias(q, "id", "question", products).join(products.select("product_id", "product_name"), "product_id").select("id", "product_id", "product_name", "alias")
    if fuzzy:
        brand = products.select("product_id", "product_name", F.lower(F.split_part(F.trim("product_name"), F.lit(" "), F.lit(1))).alias("brand"))
        near = naming.fuzzy_words(q, "id", "question", brand.select("brand").filter("brand <> ''").distinct()).select("id", "brand").distinct()
        more = near.join(brand, "brand").join(found.select("id", "product_id"), ["id", "product_id"], "left_anti").select("id", "product_id", "product_name", F.col("brand").alias("alias"))
        found = found.unionByName(more)
    # The names of one question are few: no more than there are products.
    others = found.groupBy("id").agg(F.collect_set("alias").alias("others"))
    inside = F.exists("others", lambda o: (o != F.col("alias")) & F.contains(o, F.col("alias")))
    return found.join(others, "id").filter(~inside).drop("others")


def decoded(named: DataFrame, questions: DataFrame, id_col: str, question_col: str, products: DataFrame) -> DataFrame:
    """``(id, answer)``: what the code means that ends the alias of the only product ``(id, product_id, product_name, alias)`` of a question.

    Where the question asks for a field and the option's text has it as ``Field: value; ...``, the value alone is given.
    """
    ending = named.withColumn("code", F.regexp_extract("alias", r"^.*\S\s(\S+)$", 1)).filter("code <> ''")
    options = registry.options(products).select("product_id", "pos", "label", "option_code", "option_text", F.lower("option_code").alias("code"))
    first = ending.join(options, ["product_id", "code"]).groupBy("id", "product_name").agg(F.min_by(F.struct("label", "option_code", "option_text"), F.struct("pos", "option_code")).alias("o"))
    q = first.join(questions.select(F.col(id_col).alias("id"), F.lower(question_col).alias("q")), "id")
    field, keyword = F.lit(None).cast("string"), F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for word, label in reversed(FIELDS.items()):
        here = F.contains("q", F.lit(word))
        field, keyword = F.when(here, F.lit(label)).otherwise(field), F.when(here, F.lit(label)).otherwise(keyword)
        value = F.when(here, picked_field(F.col("o.option_text"), label)).otherwise(value)
    name = F.concat(F.lit("For the "), "product_name", F.lit(', code "'), F.col("o.option_code"), F.lit('"'))
    whole = F.concat(name, F.lit(" in the "), F.col("o.label"), F.lit(" segment means: "), F.coalesce(F.col("o.option_text"), F.lit("")), F.lit("."))
    return q.select("id", F.coalesce(F.concat(name, F.lit(" -- "), field, F.lit(": "), value, F.lit(".")), whole).alias("answer"))


def dispatch(
    questions: DataFrame, id_col: str, question_col: str, products: DataFrame, vocabulary: dict[str, list[str]] = VOCABULARY, aliases: dict[str, str] = registry.TECHNOLOGY_ALIASES, fuzzy: bool = True,
) -> DataFrame:
    """``(id, kind, rule, products, catalogues, answer, exclude_references)`` of every question, by the first rule that holds.

    - decode: one product whose alias ends in one of its codes: what the code means.
    - one_product: one product, in a question that neither lists nor compares: its documents alone.
    - family_list: a list is asked for and several products share the alias: their names.
    - several_products: two or more products: their documents.
    - catalog: a list is asked for: the products that meet any of its filters, all without one.
    - attribute: nothing named, but "the ..." with a filter: the products that meet the first one.
    - whole_catalog: nothing named: all products, with references unless the question speaks of us.
    - search: all else.

    ``products`` and ``catalogues`` are sorted names and documents, as arrays; ``answer`` is null unless kind is direct. A blank or null question is searched over
    the whole catalog. Questions repeated under one id count as one.
    """
    q = questions.groupBy(F.col(id_col).alias("id")).agg(F.first(question_col, ignorenulls=True).alias("question"))
    named = named_products(q, "id", "question", products, fuzzy)
    catalogue = products.select("product_id", "source_catalogue")
    of = lambda rows: rows.groupBy("id").agg(F.array_sort(F.collect_set("product_name")).alias("products"), F.array_sort(F.collect_set("source_catalogue")).alias("catalogues"))
    # An alias shared by several products named.
    groups = named.groupBy("id", "alias").agg(F.count(F.lit(1)).alias("members"), F.collect_set("product_id").alias("ids"))
    shared = groups.filter("members > 1").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("alias")), " / ").alias("family"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("family_ids"))
    wording = ["enumerate", "which_products", "ask_about", "list_word", "the_one", "comparison", "self_reference"]
    told = q.select("id", attributes(F.col("question"), vocabulary, aliases).alias("filters"), *[asks(F.col("question"), w).alias(w) for w in wording])
    counts = named.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    codes = decoded(named.join(counts.filter("n = 1").select("id"), "id", "left_semi"), q, "id", "question", products)
    first = told.filter("size(filters) > 0").select("id", F.col("filters")[0].alias("f")).select("id", "f.field", "f.value")
    candidates = of(meets(products, first)).select("id", F.col("products").alias("fit"), F.col("catalogues").alias("fit_documents"))
    listed = of(meets(products, told.select("id", F.explode("filters").alias("f")).select("id", "f.field", "f.value"))).select("id", F.col("products").alias("listed"), F.col("catalogues").alias("listed_documents"))
    mine = of(named.join(catalogue, "product_id"))
    family = of(shared.select("id", F.explode("family_ids").alias("product_id")).join(products.select("product_id", "product_name", "source_catalogue"), "product_id")).select("id", F.col("products").alias("members"), F.col("catalogues").alias("member_documents"))
    every = products.agg(F.array_sort(F.collect_set("product_name")).alias("every"), F.array_sort(F.collect_set("source_catalogue")).alias("every_document"))  # one row
    all_ = told
    for side in (counts, codes, candidates, listed, mine, shared.select("id", "family"), family):
        all_ = all_.join(side, "id", "left")
    all_ = all_.join(F.broadcast(every))
    n, some = F.coalesce("n", F.lit(0)), F.size("filters") > 0
    lists = F.col("enumerate") | (some & (F.col("which_products") | F.col("ask_about") | F.col("list_word")))
    catalog_like = F.col("enumerate") | F.col("which_products")
    rule = (
        F.when((n == 1) & F.col("answer").isNotNull(), "decode")
        .when((n == 1) & ~catalog_like & ~F.col("comparison"), "one_product")
        .when((n >= 2) & lists & F.col("family").isNotNull(), "family_list")
        .when((n >= 2) & ~lists, "several_products")
        .when(lists, "catalog")
        .when((n == 0) & F.col("the_one") & (F.size("fit") > 0), "attribute")
        .when(n == 0, "whole_catalog")
        .otherwise("search")
    )
    all_ = all_.withColumn("rule", rule)
    none = F.array().cast("array<string>")
    pick = lambda name, plain: (
        F.when(F.col("rule").isin("decode", "one_product", "several_products"), F.col(plain))
        .when(F.col("rule") == "family_list", F.col(name[0])).when(F.col("rule") == "attribute", F.col(name[1]))
        .when((F.col("rule") == "catalog") & some, F.coalesce(F.col(name[2]), none)).when(F.col("rule").isin("catalog", "whole_catalog"), F.col(name[3])).otherwise(none)
    )
    out = all_.withColumn("chosen", pick(("members", "fit", "listed", "every"), "products")).withColumn("documents", pick(("member_documents", "fit_documents", "listed_documents", "every_document"), "catalogues"))
    by_field = F.array_distinct(F.transform("filters", lambda f: f["field"]))
    label = F.array_join(F.transform(by_field, lambda f: F.concat(F.replace(f, F.lit("_"), F.lit(" ")), F.lit(' "'), F.array_join(F.transform(F.filter("filters", lambda x: x["field"] == f), lambda x: x["value"]), " or "), F.lit('"'))), " and ")
    label = F.when(some, label).otherwise(F.lit(EVERYTHING))
    names = F.array_join("chosen", ", ")
    count = F.size("chosen").cast("string")
    text = (
        F.when(F.col("rule") == "decode", F.col("answer"))
        .when(F.col("rule") == "family_list", F.concat(count, F.lit(FAMILY), "family", F.lit('" family: '), names, F.lit(".")))
        .when((F.col("rule") == "catalog") & (F.size("chosen") == 0), F.concat(F.lit(NOTHING), label, F.lit(".")))
        .when(F.col("rule") == "catalog", F.concat(count, F.lit(MATCH), label, F.lit(": "), names, F.lit(".")))
    )
    kind = F.lit("search")
    for r, k in RULES.items():
        kind = F.when(F.col("rule") == r, F.lit(k)).otherwise(kind)
    # References have no place beside named products; a question of the whole catalog has them unless it speaks of us.
    aside = F.col("rule").isin("one_product", "several_products", "attribute") | ((F.col("rule") == "whole_catalog") & F.col("self_reference"))
    return out.select("id", kind.alias("kind"), "rule", F.col("chosen").alias("products"), F.col("documents").alias("catalogues"), text.alias("answer"), aside.alias("exclude_references"))


def type_ambiguous(questions: DataFrame, id_col: str, question_col: str, products: DataFrame, terms: dict[str, str]) -> DataFrame:
    """``(id)`` of questions that name a kind of product which several have, without naming one of them.

    ``terms`` has the spellings of a kind and the type they stand for. A product is named by all tokens of its name, or by its brand if only one product
    of that kind has the brand.
    """
    q = F.coalesce(F.lower(question_col), F.lit(""))
    kinds = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(q, F.lit(t.lower())), F.lit(k.lower())) for t, k in terms.items()])))
    asked = questions.select(F.col(id_col).alias("id"), F.array_distinct(tokens(F.col(question_col))).alias("words"), F.explode(kinds).alias("kind"))
    members = products.filter("product_type <> 'Unknown'").select(F.lower("product_type").alias("kind"), "product_name", F.array_distinct(tokens(F.col("product_name"))).alias("parts")).distinct().withColumn("brand", F.element_at("parts", 1))
    sizes = members.groupBy("kind").agg(F.count(F.lit(1)).alias("members"), F.collect_list(F.struct("parts", "brand")).alias("those")).filter("members >= 2")  # one row a kind, of the registry's products
    met = asked.join(sizes, "kind")
    whole = F.exists("those", lambda m: (F.size(m["parts"]) > 0) & (F.size(F.array_except(m["parts"], "words")) == 0))
    brands = F.array_intersect(F.array_distinct(F.transform("those", lambda m: m["brand"])), F.col("words"))
    within = F.size(F.filter("those", lambda m: m["brand"] == F.element_at(brands, 1)))
    narrowed = (F.size(brands) == 1) & (within == 1)
    return met.filter(~whole & ~F.coalesce(narrowed, F.lit(False))).select("id").distinct()
