"""Iterative workloads: a driver loop over distributed rounds.

What the driver holds between rounds is the model (centres, a direction, a weight matrix): its size is set by parameters, not by the
data. Per-client state stays distributed and is checkpointed each round, so that lineage doesn't grow.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prng, vec
from ..sources.tables import shared_folder
from . import codecs
from .estimate import coordinates, vectors_of

DIVERGED = 1e16


def literal(x) -> Column:
    """An array (of arrays) of doubles as a constant."""
    kind = "array<double>" if np.ndim(x) == 1 else "array<array<double>>"
    import json

    return F.from_json(F.lit(json.dumps(np.asarray(x, float).tolist())), kind)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder that the session names (a local one only where it names none, as in tests)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


# --- K-means ---------------------------------------------------------------------------------------------------------------------


def start_centres(k: int, dim: int) -> np.ndarray:
    """Hash uniforms in [-1, 1)."""
    return np.array([2 * prng.uniforms_array(c, dim, prng.INIT) - 1 for c in range(k)])


def nearest(points: DataFrame, centres: np.ndarray, x: str = "x") -> DataFrame:
    """points with cluster and dist (squared); the first of equally near centres. Map-only."""
    dists = vec.let(lambda s: F.transform(s["c"], lambda z: F.round(vec.squared_distance(s["x"], z), 12)), c=literal(centres), x=F.col(x))
    return points.withColumn("__ds", dists).withColumn("dist", F.array_min("__ds")).withColumn("cluster", (F.array_position("__ds", F.col("dist")) - 1).cast("int")).drop("__ds")


def cluster_sums(assigned: DataFrame, keys: list[str], dim: int, x: str = "x") -> DataFrame:
    """(keys, cluster, i, v): sums of the coordinates, and behind them of 1 (the mass, i = dim) and dist (i = dim + 1), in one pass."""
    rows = assigned.withColumn("__x", F.concat(x, F.array(F.lit(1.0), F.col("dist"))))
    return coordinates(rows, [*keys, "cluster"], "__x").groupBy(*keys, "cluster", "i").agg(F.sum("v").alias("v"))


def kmeans_round(points: DataFrame, centres: np.ndarray, codec: str = "identity") -> tuple[np.ndarray, float]:
    """New centres and the objective of the old ones.

    Each client sends its flattened cluster sums by the codec, padded to a power of two, and its masses as they are. A cluster
    without points has centre 0. The points are read once; what is kept of them is a row per client, cluster and coordinate.
    """
    k, dim = centres.shape
    sums = checkpointed(cluster_sums(nearest(points, centres), ["client"], dim))
    p = vec.next_power(k * dim)
    # a client's message is dense: absent coordinates are 0
    flat = sums.where(F.col("i") < dim).select("client", (F.col("cluster") * dim + F.col("i")).alias("i"), "v")
    zeros = sums.select("client").distinct().select("client", F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("i"), F.lit(0.0).alias("v"))
    message = vectors_of(flat.unionByName(zeros).groupBy("client", "i").agg(F.sum("v").alias("v")), ["client"], "v")
    decoded = codecs.round_trip(message, codec, p)
    merged = {r.i: r.s for r in coordinates(decoded, [], "xhat").where(F.col("i") < k * dim).groupBy("i").agg(F.sum("v").alias("s")).collect()}
    masses, objective = np.zeros(k), 0.0
    for r in sums.where(F.col("i") >= dim).groupBy("cluster", "i").agg(F.sum("v").alias("v")).collect():
        if r.i == dim:
            masses[r.cluster] = r.v
        else:
            objective += r.v
    total = np.array([merged.get(i, 0.0) for i in range(k * dim)]).reshape(k, dim)
    return np.where(masses[:, None] > 0, total / np.maximum(masses, 1)[:, None], 0.0), float(objective)


def kmeans(points: DataFrame, k: int, dim: int, rounds: int, codec: str = "identity") -> tuple[np.ndarray, list[float]]:
    """Centres after ``rounds`` and the objective before each; stops when it diverges."""
    centres, history = start_centres(k, dim), []
    for _ in range(rounds):
        centres, objective = kmeans_round(points, centres, codec)
        history.append(objective)
        if not math.isfinite(objective) or objective > DIVERGED:
            break
    return centres, history


# --- power iteration -------------------------------------------------------------------------------------------------------------


def mean_vector(points: DataFrame, dim: int) -> np.ndarray:
    """Mean of the rows used."""
    found = {r.i: r.m for r in coordinates(points, [], "x").groupBy("i").agg(F.avg("v").alias("m")).collect()}
    return np.array([found.get(i, 0.0) for i in range(dim)])


def covariance_products(points: DataFrame, mean: np.ndarray, v: np.ndarray) -> DataFrame:
    """(client, t): sum over the client's rows of <x - mean, v> (x - mean)."""
    centred = points.withColumn("__c", vec.subtract(F.col("x"), literal(mean))).withColumn("__d", vec.dot(F.col("__c"), literal(v)))
    sums = coordinates(centred.withColumn("__t", vec.scale(F.col("__c"), F.col("__d"))), ["client"], "__t").groupBy("client", "i").agg(F.sum("v").alias("v"))
    return vectors_of(sums, ["client"], "v", "t")


def power_iteration(points: DataFrame, dim: int, rounds: int, codec: str = "identity", lr: float = 1.0) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Leading direction and (eigenvalue, error) of each round.

    Clients keep a state and send the codec of what their product differs from it: state += lr * decoded. The server adds the states
    up. With the identity and lr 1 this is plain power iteration.
    """
    mean = mean_vector(points, dim)
    v = np.full(dim, 1 / math.sqrt(dim))
    p = vec.next_power(dim)
    state, history = None, []
    for _ in range(rounds):
        target = covariance_products(points, mean, v)
        if state is None:
            both = target.withColumn("state", F.array_repeat(F.lit(0.0), dim))
        else:
            both = target.join(state, "client", "left").withColumn("state", F.coalesce("state", F.array_repeat(F.lit(0.0), dim)))
        sent = codecs.round_trip(both.withColumn("x", vec.pad(vec.subtract(F.col("t"), F.col("state")), p)), codec, p)
        state = checkpointed(sent.select("client", vec.add(F.col("state"), vec.scale(F.slice("xhat", 1, dim), lr)).alias("state")))
        found = {r.i: r.s for r in coordinates(state, [], "state").groupBy("i").agg(F.sum("v").alias("s")).collect()}
        w = np.array([found.get(i, 0.0) for i in range(dim)])
        value = float(v @ w)
        history.append((value, float(np.linalg.norm(value * v - w))))
        norm = np.linalg.norm(w)
        if not math.isfinite(history[-1][1]) or history[-1][1] > DIVERGED or norm == 0:
            break
        v = w / norm
    return v, history


# --- federated softmax regression ------------------------------------------------------------------------------------------------


def softmax_gradients(points: DataFrame, weights: np.ndarray, label: str = "label") -> DataFrame:
    """(client, x, n): mean gradient of each client, flattened class by class, and its number of rows; x has a bias coordinate."""
    classes, width = weights.shape
    rows = points.withColumn("__x", F.concat("x", F.array(F.lit(1.0))))
    rows = rows.withColumn("__z", vec.let(lambda s: F.transform(s["w"], lambda w: vec.dot(s["x"], w)), w=literal(weights), x=F.col("__x")))
    rows = rows.withColumn("__e", vec.let(lambda s: F.transform(s["z"], lambda z: F.exp(z - s["m"])), z=F.col("__z"), m=F.array_max("__z"))).withColumn("__p", vec.scale(F.col("__e"), 1 / vec.total(F.col("__e"))))
    residual = F.transform("__p", lambda p, c: p - F.when(c == F.col(label), 1.0).otherwise(0.0))
    rows = rows.withColumn("__r", residual).withColumn("__g", vec.let(lambda s: F.flatten(F.transform(s["r"], lambda r: vec.scale(s["x"], r))), r=F.col("__r"), x=F.col("__x")))
    means = coordinates(rows, ["client"], "__g").groupBy("client", "i").agg(F.avg("v").alias("v"))
    return vectors_of(means, ["client"], "v").join(points.groupBy("client").agg(F.count(F.lit(1)).alias("n")), "client")


def mean_gradient(points: DataFrame, weights: np.ndarray, codec: str = "identity", weighted: bool = True) -> np.ndarray:
    """What the server decodes: the (weighted) mean of the clients' encoded gradients."""
    from .estimate import mean_estimate

    size = weights.size
    p = vec.next_power(size)
    sent = softmax_gradients(points, weights).withColumn("x", vec.pad(F.col("x"), p))
    mean = mean_estimate(codecs.round_trip(sent, codec, p), [], "xhat", "n" if weighted else None)
    found = {r.i: r["mean"] for r in mean.where(F.col("i") < size).collect()}
    return np.array([found.get(i, 0.0) for i in range(size)]).reshape(weights.shape)


def federated_round(points: DataFrame, weights: np.ndarray, codec: str = "identity", lr: float = 1.0, weighted: bool = True) -> np.ndarray:
    """New weights after one round: clients encode their negated change, the server takes the (weighted) mean of what it decodes."""
    return weights - lr * mean_gradient(points, weights, codec, weighted)


def training(points: DataFrame, classes: int, dim: int, rounds: int, codec: str = "identity", lr: float = 0.1, momentum: float = 0.9, decay: float = 5e-4) -> tuple[np.ndarray, list[float]]:
    """Weights of a softmax regression after ``rounds`` of momentum steps by the decoded mean gradient, and the accuracy after each."""
    weights = velocity = np.zeros((classes, dim + 1))
    history = []
    for _ in range(rounds):
        weights, velocity = sgd_step(weights, mean_gradient(points, weights, codec), velocity, lr, momentum, decay)
        history.append(accuracy(points, weights))
    return weights, history


def sgd_step(parameters: np.ndarray, gradient: np.ndarray, velocity: np.ndarray, lr: float, momentum: float = 0.9, decay: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Momentum step with weight decay: (parameters, velocity)."""
    velocity = momentum * velocity + gradient + decay * parameters
    return parameters - lr * velocity, velocity


def accuracy(points: DataFrame, weights: np.ndarray, label: str = "label") -> float:
    """Percentage of rows whose largest score is their label's."""
    rows = points.withColumn("__x", F.concat("x", F.array(F.lit(1.0)))).withColumn("__z", vec.let(lambda s: F.transform(s["w"], lambda w: vec.dot(s["x"], w)), w=literal(weights), x=F.col("__x")))
    return float(100 * rows.agg(F.avg((F.array_position("__z", F.array_max("__z")) - 1 == F.col(label)).cast("double"))).first()[0])
