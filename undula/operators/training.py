"""Data-parallel training of the functional autoencoder: samples stay where they are, sums meet.

A barrier stage holds the samples, dealt to its tasks, and a copy of the weights in each. Every step draws the same batch
in all tasks; each takes its own rows of it, and batch moments, their gradients and the gradients of the weights are added
up over the tasks, in the order of their numbers, so all copies move alike and the steps are those of one task with all
samples. Between stages (a few epochs) the weights, the momentum and the state of the random numbers are all there is:
that is the checkpoint from which a stage begins anew if an executor is lost. Partitions are refreshed between stages by
Spark's own clustering over the codes.

A step exchanges a few kilobytes some twenty times, so it pays for data that one task cannot hold, with batches of many
rows; a few thousand samples train faster in one task (``plans.runner``).
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.operators import cluster, evaluate, graph
from undula.operators.autoencoder import Network, encode, tensor
from undula.operators.tape import Var, backward
from undula.sources.shared import dropped, written

#: Epochs of a stage at most.
STAGE = 20


class Share:
    """One task's part of a batch: how sums over all tasks are taken. ``own`` are the places of its rows in the batch."""

    def __init__(self, gather: Callable[[str], list[str]], batch: int, own: np.ndarray, first: bool):
        self.gather, self.batch, self.own, self.first = gather, batch, own, first

    def total(self, a: np.ndarray) -> np.ndarray:
        parts = [np.frombuffer(base64.b64decode(p)) for p in self.gather(base64.b64encode(np.ascontiguousarray(a, float).tobytes()).decode())]
        return np.sum(parts, axis=0).reshape(np.shape(a))

    def mean(self, h: Var) -> Var:
        """The mean over the batch's rows in all tasks."""
        return Var(self.total(h.value.sum(0, keepdims=True)) / self.batch, ((h, lambda g: np.broadcast_to(self.total(g) / self.batch, h.value.shape)),))


def steps(net: Network, idx: np.ndarray, x: np.ndarray, labels: np.ndarray | None, n: int, gather, first: bool, rng, speed: dict, epochs: int, rate: float, batch: int, beta: float, means, mean) -> list[float]:
    """Epochs over one task's rows ``idx`` (ascending) of n samples, in step with the other tasks; losses are of whole batches."""
    out = []
    for _ in range(epochs):
        order, losses = rng.permutation(n), []
        for a in range(0, n, batch):
            some = order[a : a + batch]
            at = np.minimum(np.searchsorted(idx, some), max(len(idx) - 1, 0))
            own = np.flatnonzero(idx[at] == some) if len(idx) else np.zeros(0, int)
            rows = at[own]
            net.share = Share(gather, len(some), own, first)
            v = net.variables()
            loss = net.loss(v, x[rows], None if labels is None else labels[rows], means, mean, rng)
            backward(loss)
            names = sorted(v)
            flat = np.concatenate([*((v[k].grad if v[k].grad is not None else np.zeros_like(v[k].value)).ravel() for k in names), [float(loss.value)]])
            flat = net.share.total(flat)
            place = 0
            for k in names:
                size = v[k].value.size
                speed[k] = beta * speed[k] + (1 - beta) * flat[place : place + size].reshape(v[k].value.shape)
                net.params[k] = net.params[k] - rate * speed[k]
                place += size
            losses.append(float(flat[-1]))
        out.append(float(np.mean(losses)))
    net.share = None
    return out


def train(coefs: DataFrame, edges: DataFrame, net: Network, epochs: int, rate: float, batch: int, beta: float = 0.9, pretrain: int = 0, criterion: str = "silhouette", every: int = 5, parts: int | None = None) -> list[float]:
    """Mean loss of each epoch, as ``autoencoder.train`` gives it from (sample_id, feature, c) and (i, j, w); ``net`` is trained.

    Samples are numbered by id. ``parts`` tasks run at once, as many as the cluster has cores if not given.
    """
    spark = coefs.sparkSession
    parts = spark.sparkContext.defaultParallelism if parts is None else parts
    samples = graph.numbered(tensor(coefs), ["sample_id"], "place")
    n = samples.count()
    rng, speed = np.random.default_rng(net.seed), {k: np.zeros_like(p) for k, p in net.params.items()}
    labelled, means, mean, losses, done = None, None, None, [], 0
    while done < epochs:
        fine = net.cluster and done >= pretrain
        if fine:
            z = written(encode(coefs, net), "codes")
            labels = cluster.convex_clustering(z, edges, criterion).select("sample_id", F.col("cluster").alias("label"))
            both = z.join(labels, "sample_id")
            rows = evaluate.centroid_vectors(both).orderBy("label").collect()  # a row a cluster
            means = np.array([r["c"] for r in rows])
            mean = np.array([r["c"] for r in evaluate.global_mean(z).orderBy("k").collect()])
            dropped(labelled)
            labelled = written(labels, "labels")
            dropped(z, labels)
        size = min(epochs - done, every - (done - pretrain) % every if fine else min(STAGE, pretrain - done if net.cluster and done < pretrain else STAGE))
        table = samples.join(labelled, "sample_id") if labelled is not None else samples.withColumn("label", F.lit(None).cast("int"))
        sent = pickle.dumps((net, rng, speed))
        use = labelled is not None

        def run(batches, sent=sent, size=size, use=use, means=means, mean=mean):
            own, r, v = pickle.loads(sent)
            rows = sorted((q for b in batches for q in zip(*(b.column(k).to_pylist() for k in range(3)))), key=lambda q: q[0])
            idx = np.array([q[0] - 1 for q in rows], int)
            x = np.array([q[1] for q in rows], float).reshape(len(rows), own.features, -1) if rows else np.zeros((0, own.features, len(own.basis)))
            labels = np.array([q[2] for q in rows], int) if use else None
            task = BarrierTaskContext.get()
            first = task.partitionId() == 0
            out = steps(own, idx, x, labels, n, task.allGather, first, r, v, size, rate, batch, beta, means, mean)
            if first:
                yield pa.record_batch([pa.array([pickle.dumps((own.params, own.stats, r, v, out))], pa.binary())], ["state"])

        got = table.select("place", "x", "label").repartition(parts).mapInArrow(run, "state binary", barrier=True).collect()  # the weights
        net.params, net.stats, rng, speed, out = pickle.loads(bytes(got[0][0]))
        losses += out
        done += size
    dropped(samples, labelled)
    return losses
