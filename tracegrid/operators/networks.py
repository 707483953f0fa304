"""Networks of a case: facts from configuration lines, addresses in networks, and the graph of a
cluster's resource documents."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.tables import Tables
from .blocks import block_join

V4 = "^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:[.](?!$)|$)){4}$"
RESOURCE = (
    "kind string, metadata struct<namespace:string,name:string,labels:map<string,string>>, "
    "spec struct<nodeName:string,clusterIP:string,selector:map<string,string>,ports:array<struct<port:int,protocol:string>>,"
    "rules:array<struct<host:string,http:struct<paths:array<struct<path:string,backend:struct<service:struct<name:string>>>>>>>>, "
    "status struct<podIP:string>"
)


def _named(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def address_bits(address: Column | str) -> Column:
    """The bits of an IPv4 (32) or IPv6 address (128) as text of 0 and 1; null for anything else."""
    a = f"lower({address})"
    v4 = "array_join(transform(split(a, '[.]'), x -> lpad(conv(x, 10, 2), 8, '0')), '')"
    # a tail in IPv4 form becomes two groups
    tail = "array_join(transform(sequence(0, 1), i -> lower(conv(element_at(split(t, '[.]'), 2 * i + 1) * 256 + element_at(split(t, '[.]'), 2 * i + 2), 10, 16))), ':')"
    hexed = f"if(substring_index(a, ':', -1) RLIKE '{V4}', {_named("substring_index(a, ':', -1)", 't', f'concat(left(a, length(a) - length(t)), {tail})')}, a)"
    groups = "if(p = '', cast(array() AS array<string>), split(p, ':'))"
    halves = f"transform(split(b, '::', -1), p -> {groups})"
    whole = "CASE size(h) WHEN 1 THEN h[0] WHEN 2 THEN concat(h[0], array_repeat('0', greatest(0, 8 - size(h[0]) - size(h[1]))), h[1]) END"
    fits = "size(g) = 8 AND forall(g, x -> x RLIKE '^[0-9a-f]{1,4}$') AND (size(h) = 1 OR size(h[0]) + size(h[1]) < 8)"
    v6 = _named(hexed, "b", _named(halves, "h", _named(whole, "g", f"if({fits}, array_join(transform(g, x -> lpad(conv(x, 16, 2), 16, '0')), ''), null)")))
    return F.expr(_named(a, "a", f"CASE WHEN a RLIKE '{V4}' THEN {v4} WHEN a LIKE '%:%' THEN {v6} END"))


def valid_address(text: str) -> Column:
    """Whether a text is an address, or one with a prefix length that it can have."""
    bits = address_bits(f"substring_index({text}, '/', 1)")
    length = F.expr(f"try_cast(substring({text}, instr({text}, '/') + 1) AS int)")
    plain = ~F.col(text).contains("/")
    return bits.isNotNull() & (plain | F.coalesce(length.between(0, F.length(bits)) & F.col(text).rlike(r"/\d{1,3}$"), F.lit(False)))


def longest_prefix(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """``id, address, network_id, prefix_length``: the narrowest network that holds each address.

    ``addresses`` has id and address, ``networks`` network_id and cidr. Addresses that are in no
    network, or are none, have no row; of equal networks the least id counts. An equality of masked
    prefixes for the lengths that occur, at most 162, so no range is joined; equal addresses are
    looked up once.
    """
    net = networks.select("network_id", address_bits("substring_index(cidr, '/', 1)").alias("bits"), F.expr("try_cast(substring_index(cidr, '/', -1) AS int)").alias("n"))
    net = net.where("n BETWEEN 0 AND length(bits)").groupBy(F.length("bits").alias("width"), "n", F.expr("left(bits, n)").alias("prefix")).agg(F.min("network_id").alias("network_id"))
    lengths = net.agg(F.collect_set(F.struct("width", "n")).alias("lengths"))
    distinct = addresses.select("address").where("address IS NOT NULL").distinct().withColumn("bits", address_bits("address")).where("bits IS NOT NULL")
    probes = distinct.crossJoin(F.broadcast(lengths)).select("address", "bits", F.inline("lengths")).where("width = length(bits)")
    found = probes.withColumn("prefix", F.expr("left(bits, n)")).join(net, ["width", "n", "prefix"])
    best = found.groupBy("address").agg(F.max(F.struct("n", "network_id")).alias("best"))
    return addresses.join(best, "address").select("id", "address", "best.network_id", F.col("best.n").alias("prefix_length"))


def configured_facts(lines: DataFrame) -> DataFrame:
    """Facts of configuration lines (path, line_number, line): ``path, line_number, at, kind,
    subject, value``, in this order of their lines; ``at`` numbers the facts of one line.

    Hosts files map names to addresses, resolver files name servers, interface files give
    addresses, gateways and bridge members of the interface that was named last, and cluster
    files the links of nodes, whose names may come after their links, once a node is closed.
    """
    path = F.lower(F.translate("path", "\\", "/"))
    base = lines.select("path", path.alias("p"), "line_number", F.trim("line").alias("line")).withColumn("w", F.split("line", r"\s+"))
    base = base.withColumn("first", F.col("w")[0]).withColumn("second", F.get("w", F.lit(1)))
    file = Window.partitionBy("path").orderBy("line_number")
    row = lambda kind, subject, value: F.array(F.struct(F.lit(kind).alias("kind"), subject.alias("subject"), value.alias("value")))
    rest = F.expr("slice(w, 2, greatest(size(w) - 1, 0))")
    each = lambda kind, f, cond=None: F.transform(F.filter(rest, cond) if cond else rest, f)
    is_address = address_bits("first").isNotNull()

    hosts = base.where(F.col("p").endswith("/etc/hosts") & is_address & (F.size("w") >= 2))
    hosts = hosts.withColumn("facts", each("", lambda h: F.struct(F.lit("hostname_mapping").alias("kind"), h.alias("subject"), F.col("first").alias("value"))))
    resolver = base.where(F.col("p").endswith("/etc/resolv.conf") & (F.size("w") == 2) & (F.col("first") == "nameserver") & address_bits("second").isNotNull())
    resolver = resolver.withColumn("facts", row("dns_server", F.lit("resolver"), F.col("second")))

    face = base.where(F.col("p").endswith("/etc/network/interfaces"))
    named = F.when((F.col("first") == "iface") & (F.size("w") >= 2), F.col("second"))
    face = face.withColumn("interface", F.last(named, ignorenulls=True).over(file)).where((F.col("first") != "iface") & (F.size("w") >= 2) & F.col("interface").isNotNull())
    facts = (
        F.when((F.col("first") == "address") & valid_address("second"), row("interface_address", F.col("interface"), F.col("second")))
        .when((F.col("first") == "gateway") & address_bits("second").isNotNull(), row("gateway", F.col("interface"), F.col("second")))
        .when(F.col("first") == "bridge-ports", each("", lambda b: F.struct(F.lit("bridge_member").alias("kind"), F.col("interface").alias("subject"), b.alias("value")), lambda b: b != "none"))
    )
    face = face.withColumn("facts", facts).where("facts IS NOT NULL")

    ring = base.where(F.col("p").rlike("/etc/(?:pve|corosync)/corosync\\.conf$"))
    edge = F.when(F.col("line").startswith("node {"), 1).when(F.col("line") == "}", 0)
    ring = ring.withColumn("block", F.sum(F.when(F.col("line").startswith("node {"), 1).otherwise(0)).over(file)).withColumn("inside", F.last(edge, ignorenulls=True).over(file))
    closes = F.min(F.when((F.col("line") == "}"), F.col("line_number"))).over(Window.partitionBy("path", "block"))
    ring = ring.withColumn("close", closes).where("block > 0 AND line_number < close AND line LIKE '%:%'")
    ring = ring.withColumn("key", F.trim(F.substring_index("line", ":", 1))).withColumn("told", F.expr("trim(substring(line, instr(line, ':') + 1))"))
    node = F.coalesce(F.last(F.when(F.col("key") == "name", F.col("told")), ignorenulls=True).over(Window.partitionBy("path", "block").orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(""))
    ring = ring.withColumn("node", node).where(F.col("key").rlike("^ring.*_addr$") & valid_address("told"))
    ring = ring.withColumn("facts", row("cluster_link", F.col("node"), F.concat_ws(":", "key", "told")))

    columns = ["path", "line_number", "facts"]
    found = hosts.select(*columns).unionByName(resolver.select(*columns)).unionByName(face.select(*columns)).unionByName(ring.select(*columns))
    return found.select("path", "line_number", F.posexplode("facts").alias("at", "f")).select("path", "line_number", "at", "f.*")


def resources(documents: DataFrame) -> DataFrame:
    """Resource documents (id, document as JSON) read once: ``id`` and the fields of ``RESOURCE``.
    What is no object of a kind with a name is left out."""
    read = documents.select("id", F.from_json("document", RESOURCE).alias("r")).select("id", "r.*")
    return read.where("kind IS NOT NULL AND metadata.name IS NOT NULL").withColumn("namespace", F.coalesce("metadata.namespace", F.lit("default")))


def resource_key(kind: Column, namespace: Column, name: Column) -> Column:
    return F.concat_ws("/", kind, namespace, name)


def resource_nodes(read: DataFrame) -> DataFrame:
    """``node_id, node_type, label, address``: one node for each resource, and the machines that pods name."""
    name = F.col("metadata.name")
    own = read.select(resource_key(F.col("kind"), F.col("namespace"), name).alias("node_id"), F.lower("kind").alias("node_type"), name.alias("label"), F.coalesce("status.podIP", "spec.clusterIP").alias("address"))
    machines = read.where("spec.nodeName IS NOT NULL").select(F.concat(F.lit("Machine/"), "spec.nodeName").alias("node_id"), F.lit("machine").alias("node_type"), F.col("spec.nodeName").alias("label"), F.lit(None).cast("string").alias("address"))
    return own.unionByName(machines).groupBy("node_id", "node_type", "label").agg(F.min("address").alias("address"))


def resource_edges(read: DataFrame) -> DataFrame:
    """``source_id, relation, target_id, detail``: services select pods, pods run on machines,
    ingresses route to services.

    A service selects the pods of its namespace that have all of its labels. Different selectors
    meet different sets of labels first: a selector is joined by the rarest of its labels, and the
    others are compared after, so a label that all pods share joins nothing. Services and pods
    follow by the number of a set. A pair can come twice only if a pod is told with several sets;
    of these pods alone pairs are compared with each other.
    """
    tables = Tables(read.sparkSession, "resource-edges")
    key = resource_key(F.col("kind"), F.col("namespace"), F.col("metadata.name"))
    pairs = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("value"))))
    pods = tables.put(read.where("kind = 'Pod' AND size(metadata.labels) > 0").select(key.alias("target_id"), "namespace", pairs("metadata.labels").alias("labels")).distinct())
    services = tables.put(read.where("kind = 'Service' AND size(spec.selector) > 0").select(key.alias("source_id"), "namespace", pairs("spec.selector").alias("selector")).distinct())
    sets = tables.put(pods.select("namespace", "labels").distinct().withColumn("set", F.monotonically_increasing_id()))
    selectors = tables.put(services.select("namespace", "selector").distinct().withColumn("asks", F.monotonically_increasing_id()))

    of_sets = sets.select("set", "namespace", "labels", F.inline("labels"))
    counts = of_sets.groupBy("namespace", "label", "value").agg(F.count("*").alias("n"))
    asked = selectors.select("asks", "namespace", F.inline("selector"))
    rarest = asked.join(counts, ["namespace", "label", "value"], "left").groupBy("asks").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "label", "value")).alias("r"))
    chosen = selectors.join(rarest.select("asks", "r.label", "r.value"), "asks")
    all_there = F.forall("selector", lambda e: F.array_contains("labels", e))
    met = chosen.join(of_sets, ["namespace", "label", "value"]).where(all_there).select("asks", "set")

    asking = services.join(selectors, ["namespace", "selector"]).join(met, "asks")
    left = tables.put(asking.select("source_id", "set").distinct())
    right = tables.put(pods.join(sets, ["namespace", "labels"]).select("target_id", "set"))
    several = tables.put(right.groupBy("target_id").agg(F.count("*").alias("n")).where("n > 1").select("target_id"))
    if several.isEmpty():
        selects = block_join(left, right, ["set"], tables).select("source_id", "target_id")
    else:
        once, more = (tables.put(right.join(several, "target_id", how)) for how in ("left_anti", "left_semi"))
        selects = block_join(left, once, ["set"], tables).select("source_id", "target_id").unionAll(block_join(left, more, ["set"], tables).select("source_id", "target_id").distinct())

    none = F.lit("").alias("detail")
    found = selects.select("source_id", F.lit("selects").alias("relation"), "target_id", none)
    runs = read.where("kind = 'Pod' AND spec.nodeName IS NOT NULL").select(key.alias("source_id"), F.lit("runs_on").alias("relation"), F.concat(F.lit("Machine/"), "spec.nodeName").alias("target_id"), none)
    rules = read.where("kind = 'Ingress'").select(key.alias("source_id"), "namespace", F.explode("spec.rules").alias("rule"))
    routes = rules.select("source_id", "namespace", F.coalesce("rule.host", F.lit("*")).alias("host"), F.explode("rule.http.paths").alias("p"))
    routes = routes.where("p.backend.service.name IS NOT NULL").select(
        "source_id", F.lit("routes_to").alias("relation"), resource_key(F.lit("Service"), F.col("namespace"), F.col("p.backend.service.name")).alias("target_id"), F.concat("host", F.coalesce("p.path", F.lit("/"))).alias("detail")
    )
    return found.unionByName(runs.distinct()).unionByName(routes.distinct())
