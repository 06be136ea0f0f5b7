"""The dataflow activities by name: what each runs here. Names are those that workflows use; the same function serves the
models whose frames have the same form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import doc, flow
from weft.operators import graph as G
from weft.sources import files


def _table(spark, name):
    return spark.table(name)


def _unwind(df, path, preserve_null=False):
    return doc.Collection(df).unwind({"path": path, "preserveNullAndEmptyArrays": preserve_null}).df


def _modify(df, changes):
    """changes: (action, field[, value]) in order: setValue, null, remove, move, arrWrap, parse (a schema), emptyObj, emptyArr."""
    for action, field, *value in changes:
        c = doc.Query(df.schema).at(field)
        if action == "remove":
            df = doc.drop(df, field)
        elif action == "move":
            df = doc.drop(doc.put(df, value[0], c), field)
        else:
            df = doc.put(df, field, {
                "setValue": lambda: F.lit(value[0]), "null": lambda: F.lit(None).cast("string"), "arrWrap": lambda: F.array(c), "parse": lambda: F.from_json(c, value[0]),  # noqa: B023
                "emptyObj": lambda: F.struct(), "emptyArr": lambda: F.array().cast("array<string>"),
            }[action]())
    return df


def _doc_to_rel(df, columns):
    """columns: name -> (path, type)."""
    q = doc.Query(df.schema)
    return df.select(*[q.at(p).cast(k).alias(n) for n, (p, k) in columns.items()])


def _aggregate_docs(df, field, calls):
    return doc.Collection(df).group({"_id": f"${field}" if field else None, **calls}).df


def _split_graph(graph, name, delimiter):
    """A text property becomes numbered properties."""
    def split(d):
        parts = F.transform(F.split(F.col("properties")[name], delimiter), lambda x, i: F.struct(F.concat(F.lit(name), i.cast("string")).alias("key"), x.alias("value")))
        return d.withColumn("properties", F.when(F.col("properties")[name].isNull(), F.col("properties")).otherwise(F.map_concat("properties", F.map_from_entries(parts))))

    return G.Graph(split(graph.nodes), split(graph.edges))


def _any_to_lpg(nodes, edges):
    """nodes: (frame, label, key); edges: (frame, label, source column, target column)."""
    n = [G.node_rows(*x) for x in nodes]
    e = [G.edge_rows(*x) for x in edges]
    return G.Graph(flow.merge(*n), flow.merge(*e))


def _unsupported(*_, **__):
    raise NotImplementedError("needs a network or a shell")


ACTIVITIES = {
    "debug": flow.identity, "identity": flow.identity, "docIdentity": flow.identity, "lpgIdentity": flow.identity, "nestedInput": flow.identity, "nestedOutput": flow.identity,
    "docAggregate": _aggregate_docs, "relAggregate": flow.aggregate,
    "docCombine": flow.combine_documents, "relColAppend": flow.append_columns, "docInsert": flow.append_columns,
    "docDeduplicate": flow.deduplicate, "relDeduplicate": flow.deduplicate, "lpgDeduplicate": G.Graph.deduplicate,
    "docEfficientFilter": flow.efficient_filter, "relEfficientFilter": flow.efficient_filter, "docFilter": flow.filter_rows, "relFilter": flow.filter_rows,
    "lpgFilterLabels": G.Graph.filter_labels, "lpgFilterProperty": G.Graph.filter_property,
    "docImputation": flow.impute, "relImputation": flow.impute, "docLookup": flow.lookup, "relLookup": flow.lookup,
    "docMerge": flow.merge, "relMerge": flow.merge, "lpgMerge": G.Graph.union, "docUnion": flow.merge, "relUnion": flow.union_rows, "lpgUnion": G.Graph.union,
    "docModify": _modify, "docRename": flow.rename, "relRename": flow.rename, "lpgLabelRename": G.Graph.rename_labels, "lpgPropertyRename": G.Graph.rename_properties,
    "docSelectFields": flow.select_fields, "reorderCols": flow.reorder, "docSort": flow.sort, "relSort": flow.sort,
    "docStringClean": flow.string_clean, "relStringClean": flow.string_clean, "lpgStringClean": G.Graph.clean_properties,
    "docStringSplit": flow.split_to_array, "relStringSplit": flow.string_split, "lpgStringSplit": _split_graph, "docStringTemplate": flow.string_template,
    "docUnwind": _unwind, "relAddCol": flow.add_column, "relCast": flow.cast, "relJoin": flow.join, "relPivot": flow.pivot, "relUnpivot": flow.unpivot,
    "relValidateCols": flow.validate_columns, "validateCount": flow.validate_count, "surrogateKey": flow.surrogate_key,
    "anyToLpg": _any_to_lpg, "docToLpg": G.from_documents, "docToRel": _doc_to_rel, "lpgEdgesToDoc": G.Graph.edges_to_documents, "lpgEdgesToRel": G.Graph.edges_to_rows,
    "lpgNodesToDoc": G.Graph.nodes_to_documents, "lpgNodesToRel": G.Graph.nodes_to_rows, "relToDoc": lambda df: doc.Collection(df).to_json(),
    "docCreate": files.inline_json, "relCreate": files.inline_csv, "docExtract": _table, "relExtract": _table, "lpgExtract": files.read_graph, "docExtractBinary": files.read_binary,
    "docExtractJson": files.read_json, "docExtractText": files.read_text, "docExtractXml": files.read_xml, "relExtractCsv": files.read_csv, "docValues": files.random_rows,
    "relValues": files.random_rows, "lpgValues": files.random_graph, "relEmptyTable": files.empty_table,
    "docLoad": files.write_table, "relLoad": files.write_table, "lpgLoad": files.write_graph, "docLoadJson": files.write_json, "relLoadCsv": files.write_csv,
    "docJavaTransform": flow.user_transform, "relJavaTransform": flow.user_transform, "lpgJavaTransform": lambda graph, f: f(graph), "nestedWorkflow": flow.nested, "query": flow.query,
    "restRequest": _unsupported, "shellCommand": _unsupported,
    "colNameToVariable": flow.column_names, "docToVariable": flow.to_variables, "relToVariable": flow.to_variables, "envVariables": lambda: dict(__import__("os").environ),
    "variableModify": flow.modify_variables, "variableStringTemplate": flow.template_variable, "variableToDocument": flow.from_variables, "variableToRow": flow.from_variables, "variableValidate": flow.validate_variables,
}


def run(steps: list[tuple], inputs: dict) -> dict:
    """A workflow whose steps name their activities: (output, activity, names of inputs, settings)."""
    return flow.run([(out, ACTIVITIES[name], sources, settings) for out, name, sources, settings in steps], inputs)
