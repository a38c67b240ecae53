"""Pricing agents in NumPy: a table of Q values, a deep Q network and a proximal policy; and how they are trained."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from pricewright.operators.market import Episode, Market


class Agent(ABC):
    """What a market asks of an agent."""

    @abstractmethod
    def choose(self, state: np.ndarray, explore: bool = True) -> int: ...

    def observe(self, state, action, reward, following, done) -> None:  # noqa: B027
        """Learn from one step."""

    def on_episode_end(self) -> None:  # noqa: B027
        """Learn from one episode."""


class Hold(Agent):
    """Keeps the price."""

    def __init__(self, market: Market):
        self.move = int(np.argmin(np.abs(np.array(market.actions) - 1)))

    def choose(self, state: np.ndarray, explore: bool = True) -> int:
        return self.move


class TableQ(Agent):
    """Q learning over states cut into bins."""

    def __init__(self, n_actions: int, bins: int = 12, gamma: float = 0.95, alpha: float = 0.1, epsilon: float = 1.0, least: float = 0.05, decay: float = 0.999, seed: int = 0):
        self.n, self.bins, self.gamma, self.alpha = n_actions, bins, gamma, alpha
        self.epsilon, self.least, self.decay = epsilon, least, decay
        self.rng, self.table = np.random.default_rng(seed), {}

    def values(self, state: np.ndarray) -> np.ndarray:
        key = tuple(np.clip((np.asarray(state) / 2 * self.bins).astype(int), 0, self.bins - 1))
        return self.table.setdefault(key, np.zeros(self.n))

    def choose(self, state: np.ndarray, explore: bool = True) -> int:
        if explore and self.rng.random() < self.epsilon:
            return int(self.rng.integers(self.n))
        return int(np.argmax(self.values(state)))

    def observe(self, state, action, reward, following, done) -> None:
        q = self.values(state)
        target = reward if done else reward + self.gamma * self.values(following).max()
        q[action] += self.alpha * (target - q[action])

    def on_episode_end(self) -> None:
        self.epsilon = max(self.least, self.epsilon * self.decay)


class Net:
    """A small ReLU network with Adam."""

    def __init__(self, sizes: tuple[int, ...], rate: float, rng: np.random.Generator):
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.rate, self.t = rate, 0
        self.m = [np.zeros_like(p) for p in [*self.w, *self.b]]
        self.v = [np.zeros_like(p) for p in [*self.w, *self.b]]

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.layers = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            x = x @ w + b
            if i < len(self.w) - 1:
                x = np.maximum(x, 0)
            self.layers.append(x)
        return x

    def step(self, slope: np.ndarray) -> None:
        """One Adam step against the slope of the loss in the last output."""
        gw, gb = [], []
        for i in range(len(self.w) - 1, -1, -1):
            gw.insert(0, self.layers[i].T @ slope)
            gb.insert(0, slope.sum(0))
            if i:
                slope = (slope @ self.w[i].T) * (self.layers[i] > 0)
        self.t += 1
        for k, (p, g) in enumerate(zip([*self.w, *self.b], [*gw, *gb], strict=True)):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            p -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

    def copy_to(self, other: Net) -> None:
        other.w, other.b = [w.copy() for w in self.w], [b.copy() for b in self.b]


class DeepQ(Agent):
    """A Q network of two layers with replay and a slow target."""

    def __init__(self, n_states: int, n_actions: int, gamma: float = 0.95, rate: float = 1e-3, epsilon: float = 1.0, least: float = 0.05, decay: float = 0.999,
                 replay: int = 50_000, batch: int = 64, sync: int = 500, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.n, self.gamma, self.batch, self.sync = n_actions, gamma, batch, sync
        self.epsilon, self.least, self.decay = epsilon, least, decay
        self.net, self.target = (Net((n_states, 64, 64, n_actions), rate, self.rng) for _ in range(2))
        self.net.copy_to(self.target)
        self.replay, self.steps = deque(maxlen=replay), 0

    def choose(self, state: np.ndarray, explore: bool = True) -> int:
        if explore and self.rng.random() < self.epsilon:
            return int(self.rng.integers(self.n))
        return int(self.net.forward(np.asarray(state)[None]).argmax())

    def observe(self, state, action, reward, following, done) -> None:
        self.replay.append((state, action, reward, following, done))
        if len(self.replay) < self.batch:
            return
        picked = [self.replay[i] for i in self.rng.integers(len(self.replay), size=self.batch)]
        s, a, r, s2, d = (np.array(c) for c in zip(*picked, strict=True))
        goal = r + self.gamma * self.target.forward(s2).max(1) * (1 - d)
        q = self.net.forward(s)
        slope = np.zeros_like(q)
        slope[np.arange(len(a)), a] = 2 * (q[np.arange(len(a)), a] - goal) / len(a)
        self.net.step(slope)
        self.steps += 1
        if self.steps % self.sync == 0:
            self.net.copy_to(self.target)

    def on_episode_end(self) -> None:
        self.epsilon = max(self.least, self.epsilon * self.decay)


def advantages(rewards, values, dones, last: float, gamma: float = 0.99, spread: float = 0.95) -> np.ndarray:
    """Generalised advantages by a scan from the end, cut where an episode ends."""
    out, run, ahead = np.zeros(len(rewards)), 0.0, last
    for i in range(len(rewards) - 1, -1, -1):
        open_ = 1.0 - float(dones[i])
        run = rewards[i] + gamma * ahead * open_ - values[i] + gamma * spread * open_ * run
        out[i], ahead = run, values[i]
    return out


class Proximal(Agent):
    """Clipped policy gradient with a value network and an entropy bonus."""

    def __init__(self, n_states: int, n_actions: int, gamma: float = 0.99, rate: float = 3e-4, spread: float = 0.95, clip: float = 0.2, epochs: int = 10,
                 rollout: int = 2048, entropy: float = 0.01, scale: float = 0.01, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.policy, self.critic = Net((n_states, 64, 64, n_actions), rate, self.rng), Net((n_states, 64, 64, 1), rate, self.rng)
        self.gamma, self.spread, self.clip, self.epochs = gamma, spread, clip, epochs
        self.rollout, self.entropy, self.scale, self.memory = rollout, entropy, scale, []

    def chances(self, states: np.ndarray) -> np.ndarray:
        z = self.policy.forward(states)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def choose(self, state: np.ndarray, explore: bool = True) -> int:
        p = self.chances(np.asarray(state)[None])[0]
        return int(self.rng.choice(len(p), p=p)) if explore else int(p.argmax())

    def observe(self, state, action, reward, following, done) -> None:
        self.memory.append((state, action, reward * self.scale, done))
        if len(self.memory) >= self.rollout:
            self.learn(following)

    def learn(self, following: np.ndarray) -> None:
        s, a, r, d = (np.array(c) for c in zip(*self.memory, strict=True))
        self.memory = []
        v, last = self.critic.forward(s)[:, 0], float(self.critic.forward(np.asarray(following)[None])[0, 0])
        gain = advantages(r, v, d, last, self.gamma, self.spread)
        goal, old, at = gain + v, self.chances(s)[np.arange(len(a)), a], np.arange(len(a))
        gain = (gain - gain.mean()) / (gain.std() + 1e-8)
        for _ in range(self.epochs):
            p = self.chances(s)
            ratio = p[at, a] / np.maximum(old, 1e-12)
            inside = ~(((gain > 0) & (ratio > 1 + self.clip)) | ((gain < 0) & (ratio < 1 - self.clip)))
            push = -(gain * ratio * inside)[:, None] * (np.eye(p.shape[1])[a] - p)
            bits = np.log(np.maximum(p, 1e-12))
            push += self.entropy * p * (bits - (p * bits).sum(1, keepdims=True))
            self.policy.step(push / len(a))
            self.critic.step(2 * (self.critic.forward(s)[:, :1] - goal[:, None]) / len(a))


def make(kind: str, n_actions: int, seed: int = 0, **options) -> Agent:
    if kind == "table":
        return TableQ(n_actions, seed=seed, **options)
    return {"deep": DeepQ, "proximal": Proximal}[kind](4, n_actions, seed=seed, **options)


def play(episode: Episode, agent: Agent, learn: bool = False, explore: bool = False) -> list[dict]:
    """One episode, as a row for each week."""
    state, done, out = episode.reset(), False, []
    while not done:
        action = agent.choose(state, explore=explore)
        following, reward, done = episode.step(action)
        if learn:
            agent.observe(state, action, reward, following, done)
        out.append({"t": episode.t, "price": episode.price, "rival": episode.rival(), "share": episode.share, "cvr": episode.rate,
                    "units": episode.units, "profit": reward})
        state = following
    if learn:
        agent.on_episode_end()
    return out


def train(market: Market, agent: Agent, episodes: int, strategy: str = "static", seed: int = 0, **options) -> list[float]:
    """Profit of each training episode; every episode has a seed of its own."""
    return [sum(r["profit"] for r in play(Episode(market, strategy, seed + i, **options), agent, True, True)) for i in range(episodes)]


def train_curriculum(market: Market, kind: str = "proximal", pretrain: int = 50, rounds: int = 2, each: int = 20, seed: int = 0, **options) -> tuple[Agent, Agent]:
    """Against a promotion cycle first, then best responses in turn to the other side, which stands still and greedy."""
    ours, theirs = (make(kind, len(market.actions), seed + i, **options) for i in range(2))
    for agent in (ours, theirs):
        train(market, agent, pretrain, "promo_cycler", seed)
    for r in range(rounds):
        for mine, other in ((ours, theirs), (theirs, ours)):
            train(market, mine, each, "RL", seed + 1000 * (r + 1), rival_agent=other, rival_explores=False)
    return ours, theirs


def assess(market: Market, agent: Agent, strategy: str = "static", runs: int = 20, seed: int = 0) -> dict[str, float]:
    """Mean profit of a policy, of holding the price, and the lift."""
    mine, hold = ([sum(r["profit"] for r in play(Episode(market, strategy, seed + i, stochastic=True), a)) for i in range(runs)] for a in (agent, Hold(market)))
    return {"profit": float(np.mean(mine)), "hold": float(np.mean(hold)), "lift": float(np.mean(mine) - np.mean(hold))}


def head_to_head(market: Market, ours: Agent, theirs: Agent, seed: int = 0) -> list[dict]:
    """Two frozen, greedy policies in one market."""
    return play(Episode(market, "RL", seed, rival_agent=theirs, rival_explores=False), ours)


def monte_carlo(spark: SparkSession, market: Market, agent: Agent, strategy: str, runs: int = 500, seed: int = 0) -> DataFrame:
    """A row for each run and week; runs are dealt out over tasks, and each has a seed of its own."""
    shared = spark.sparkContext.broadcast((market, agent))

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, a = shared.value
        for batch in batches:
            rows = [{"run": int(i)} | r for i in batch["id"] for r in play(Episode(m, strategy, seed + int(i), stochastic=True), a)]
            if rows:
                yield pd.DataFrame(rows)

    schema = "run long, t long, price double, rival double, share double, cvr double, units double, profit double"
    return spark.range(runs).mapInPandas(roll, schema)


def train_many(spark: SparkSession, markets: dict[str, Market], kinds: list[str], seeds: list[int], episodes: int, strategy: str = "static") -> DataFrame:
    """(market, kind, seed, profit, hold, lift): each agent learns in a task of its own."""
    jobs = spark.createDataFrame([(n, m.to_json(), k, s) for n, m in markets.items() for k in kinds for s in seeds], "market string, body string, kind string, seed long")

    def run(job: pd.DataFrame) -> pd.DataFrame:
        row = job.iloc[0]
        market = Market.from_json(row["body"])
        agent = make(row["kind"], len(market.actions), int(row["seed"]))
        train(market, agent, episodes, strategy, int(row["seed"]))
        return pd.DataFrame([{"market": row["market"], "kind": row["kind"], "seed": row["seed"], **assess(market, agent, strategy, 5)}])

    return jobs.groupBy("market", "kind", "seed").applyInPandas(run, "market string, kind string, seed long, profit double, hold double, lift double")
