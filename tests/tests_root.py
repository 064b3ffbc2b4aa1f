from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
