"""Rounds of messages on a page's graph with given weights: attention over incoming edges, LSTM update, scores of relations.

Weights are plain arrays, however they came about; nothing here is trained.  A page's graph is small, so each is worked on whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


@dataclass
class Dense:
    """A layer x W + b with an activation (identity without one)."""

    weights: np.ndarray
    bias: np.ndarray
    activation: object = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = x @ self.weights + self.bias
        return self.activation(out) if self.activation else out


def stack(layers: list[Dense], x: np.ndarray) -> np.ndarray:
    for layer in layers:
        x = layer(x)
    return x


@dataclass
class Head:
    """Of one attention head: the messages of edges, and their scores (None: each incoming edge weighs the same)."""

    message: list[Dense]
    score: list[Dense] | None = None


@dataclass
class Network:
    heads: list[Head]
    gates: dict[str, Dense]  # in, out, forget, cell
    relation: list[Dense]  # of a pair's states, class logits
    rounds: int = 3
    merge: str = "concat"  # or average
    output: str = "concat"  # states with the input features behind, or states alone
    compress: list[Dense] = field(default_factory=list)


def pair_features(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """From, to, difference and squared difference of every edge's nodes."""
    a, b = values[edges[:, 0]], values[edges[:, 1]]
    return np.concatenate([a, b, b - a, (b - a) ** 2], axis=1)


def into(values: np.ndarray, edges: np.ndarray, n: int) -> np.ndarray:
    """Sum over every node's incoming edges."""
    out = np.zeros((n, *values.shape[1:]))
    np.add.at(out, edges[:, 1], values)
    return out


def attention(scores: np.ndarray | None, edges: np.ndarray, n: int) -> np.ndarray:
    """Weights of edges that add up to 1 at every node: a softmax of scores, or equal ones."""
    if scores is None:
        return 1 / np.bincount(edges[:, 1], minlength=n)[edges[:, 1]]
    top = np.full(n, -np.inf)
    np.maximum.at(top, edges[:, 1], scores)
    e = np.exp(scores - top[edges[:, 1]])
    return e / into(e, edges, n)[edges[:, 1]]


def messages(net: Network, nodes: np.ndarray, state: np.ndarray, edges: np.ndarray, edge_features: np.ndarray) -> np.ndarray:
    """What every node receives, over all heads."""
    x = np.concatenate([pair_features(nodes, edges), edge_features, pair_features(state, edges)], axis=1)
    found = []
    for head in net.heads:
        weight = attention(stack(head.score, x)[:, 0] if head.score else None, edges, len(nodes))
        found.append(into(stack(head.message, x) * weight[:, None], edges, len(nodes)))
    return np.mean(found, axis=0) if net.merge == "average" else np.concatenate(found, axis=1)


def update(net: Network, received: np.ndarray, state: np.ndarray, nodes: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next state and cell of every node."""
    x = np.concatenate([received, state, nodes], axis=1)
    cell = net.gates["forget"](x) * cell + net.gates["in"](x) * net.gates["cell"](x)
    return net.gates["out"](x) * np.tanh(cell), cell


def node_states(net: Network, nodes: np.ndarray, edges: np.ndarray, edge_features: np.ndarray) -> np.ndarray:
    """All nodes after the rounds; without edges nodes receive nothing."""
    own = stack(net.compress, nodes)
    size = net.gates["in"].bias.shape[0]
    state, cell = np.zeros((len(nodes), size)), np.zeros((len(nodes), size))
    for _ in range(net.rounds):
        state, cell = update(net, messages(net, own, state, edges, edge_features), state, own, cell)
    return np.concatenate([state, nodes], axis=1) if net.output == "concat" else state


def relation_scores(net: Network, nodes: np.ndarray, edges: np.ndarray, edge_features: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Class probabilities of pairs of nodes."""
    states = node_states(net, nodes, edges, edge_features)
    logits = stack(net.relation, np.concatenate([states[pairs[:, 0]], states[pairs[:, 1]]], axis=1))
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def example(node_dim: int, edge_dim: int, state_dim: int = 4, message_dim: int = 6, heads: int = 2, classes: int = 2) -> Network:
    """Fixed weights by a rule (cosines of their place), to run the network without a trained one."""

    def dense(rows: int, columns: int, turn: int, activation=None) -> Dense:
        place = np.arange(rows * columns, dtype=float).reshape(rows, columns)
        return Dense(np.cos(place * 0.7 + turn) / np.sqrt(rows), np.cos(np.arange(columns) + turn) / 10, activation)

    wide, part = 4 * node_dim + edge_dim + 4 * state_dim, message_dim // heads
    own = [Head([dense(wide, 8, 10 * k, relu), dense(8, part, 10 * k + 1, np.tanh)], [dense(wide, 1, 10 * k + 2)]) for k in range(heads)]
    into_ = message_dim + state_dim + node_dim
    gates = {n: dense(into_, state_dim, 100 + k, np.tanh if n == "cell" else sigmoid) for k, n in enumerate(("in", "out", "forget", "cell"))}
    return Network(own, gates, [dense(2 * (state_dim + node_dim), 8, 200, relu), dense(8, classes, 201)])
