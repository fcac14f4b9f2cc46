"""The smallest tables with a third of all transactions under one card, address, device and start day, half without an address and a third without a sender domain."""

import glob
import os
import shutil

import pandas as pd


def skewed_tables(sf_dir, folder):
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        if os.path.basename(path) not in ("merged_train.parquet", "documents.parquet", "embeddings.parquet"):
            (shutil.copytree if os.path.isdir(path) else shutil.copy)(path, f"{folder}/{os.path.basename(path)}")
    df = pd.read_parquet(f"{sf_dir}/merged_train.parquet")
    part = df["TransactionID"] % 6
    day = (df["TransactionDT"] - 86_400) // 86_400
    one = part < 2
    df.loc[one, "card1"], df.loc[one, "addr1"], df.loc[one, "DeviceInfo"] = 4242, 315.0, "same"
    df.loc[one, "D1"] = (day[one] - 3).astype(float)
    df.loc[part.isin([2, 3, 4]), "addr1"] = None
    df.loc[part.isin([1, 4]), "P_emaildomain"] = None
    df.to_parquet(f"{folder}/merged_train.parquet", index=False, coerce_timestamps="us")
    return str(folder)
