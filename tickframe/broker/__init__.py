"""Order simulation of strategies, many series and parameter sets at a time."""

from tickframe.broker.drawing import Drawings
from tickframe.broker.inputs import Inputs, Symbol
from tickframe.broker.kernel import Account, Broker, Order
from tickframe.broker.run import TRADES, backtest, run, sweep

__all__ = ["TRADES", "Account", "Broker", "Drawings", "Inputs", "Order", "Symbol", "backtest", "run", "sweep"]
