"""Log filters."""

import logging
import time


class Throttle(logging.Filter):
    """Lets one record pass in each ``seconds``; the others are dropped."""

    def __init__(self, seconds: float, clock=time.monotonic):
        super().__init__()
        self.seconds, self.clock, self.last = seconds, clock, None

    def filter(self, record: logging.LogRecord) -> bool:
        now = self.clock()
        if self.last is not None and now - self.last < self.seconds:
            return False
        self.last = now
        return True
